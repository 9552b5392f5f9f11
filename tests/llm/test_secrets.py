"""The secret scan on labelled lines of many kinds: trained on a half, judged on the other."""

import base64
import hashlib
import random
import string
import uuid

from pyspark.sql import functions as F

from tidemark.llm import secrets

DOC = "doc_id long, text string, source string"
KEY = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(base64.b64encode(hashlib.sha512(bytes([k])).digest()).decode()[:64] for k in range(14)) + "\n-----END RSA PRIVATE KEY-----"


def lines(seed, n):
    """(line, the secret in it or none): settings, code and headers with keys, against digests, ids, addresses, names and data."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        raw = bytes(r.randrange(256) for _ in range(48))
        hexed, b64 = raw.hex()[: r.choice([32, 40, 48, 64])], base64.b64encode(raw).decode()[: r.choice([24, 32, 40, 44])].rstrip("=")
        human = "".join(r.choice(string.ascii_letters + string.digits + "!#%@") for _ in range(r.randint(10, 18)))
        value = r.choice([hexed, b64, b64])
        secret = r.choice([
            (f"export STRIPE_SECRET={value}", value), (f"  client_secret: '{value}'", value), (f'conn = connect(host, password="{human}")', human), (f'{{"api_key": "{value}", "on": true}}', value),
            (f"curl -H 'Authorization: Bearer {value}' https://api.site.org/v1", value), (f"auth_token = {value}", value), (f"DB_PASSWORD={human}", human), (f"my $access_key = '{b64}';", b64),
        ])
        name = "".join(w.capitalize() for w in r.sample(["account", "manager", "payment", "default", "service", "factory", "internal", "response", "handler"], 4))
        path = "/".join(r.sample(["usr", "local", "share", "documentation", "examples", "packages", "templates", "interface"], 5))
        harmless = r.choice([
            f"commit {hexed}", f"sha256:{raw.hex()}  image.iso", f"request id {uuid.UUID(bytes=raw[:16])} done", f'"integrity": "sha512-{base64.b64encode(raw).decode()}"', f"import org.company.{name};",
            f"see /{path} for more", f"md5sum: {raw.hex()[:32]}", f"<img src='data:image/png;base64,{base64.b64encode(raw * 6).decode()}'>", "password: required for all users", "token = os.environ", f"ETag: \"{raw.hex()[:40]}\"", "-" * 60,
        ])
        out += [secret, (harmless, None)]
    return out


def found(spark, rows, first):
    docs = spark.createDataFrame([(first + i, t, "app/settings.py") for i, (t, _) in enumerate(rows)], DOC)
    return docs, {first + i: s for i, (_, s) in enumerate(rows)}


def rates(rows, truth):
    said = {(r["doc_id"], r["candidate"]) for r in rows if r["is_secret"]}
    real = {(i, s) for i, s in truth.items() if s}
    return len(said & real) / max(1, len(said)), len(said & real) / len(real)


def test_held_out_precision_and_recall(spark):
    train, truth = found(spark, lines(1, 300), 0)
    answer = spark.createDataFrame([(i, s) for i, s in truth.items()], "doc_id long, secret string")
    labelled = secrets.candidates(train).join(answer, "doc_id").withColumn("label", F.coalesce((F.col("candidate") == F.col("secret")).cast("double"), F.lit(0.0)))
    other, want = found(spark, lines(2, 300), 10_000)
    precision, recall = rates(secrets.scan(other, labelled).collect(), want)
    assert precision >= 0.95 and recall >= 0.95, (precision, recall)
    precision, recall = rates(secrets.scan(other).collect(), want)  # without labels, by the made-up findings
    assert precision >= 0.85 and recall >= 0.85, (precision, recall)


def test_private_key_is_one_finding(spark):
    rows = [(1, f"before\n{KEY}\nafter", "id_rsa"), (2, "-----BEGIN PRIVATE KEY-----\n" + "-a" * 50_000, None), (3, None, None), (4, "", "x"), (5, "word " * 200_000 + f"password='{'k3Y!' * 4}'", "x"), (5, f"secret={'0f' * 20}", "x"), (None, f"secret={'0f' * 20}", None)]
    got = secrets.scan(spark.createDataFrame([(*x, "clash") for x in rows], DOC + ", candidate string")).collect()
    assert [(r["n"], r["candidate"], r["is_secret"]) for r in got if r["doc_id"] == 1] == [(0, KEY, True)]
    assert {r["doc_id"] for r in got} - {2} == {1, 5, None} and sum(r["doc_id"] == 5 for r in got) == 2
    one, two = [r["score"] for r in got if r["candidate"] == "0f" * 20]
    assert one == two


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], DOC)).count() == 0


def test_dictionary(spark):
    d = spark.createDataFrame([(1, "the cat, the dog THE x", None), (2, "cat ab été été", None), (3, None, None)], DOC)
    assert secrets.dictionary(d) == ["the", "cat", "été"] and secrets.dictionary(d, size=1) == ["the"]
