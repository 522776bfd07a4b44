import hashlib
import random
import re

from pyspark.sql import functions as F

from threadloom.llm import secrets_scan as ss
from threadloom.llm.registry import secret_digests


def plain(text):
    """The base patterns of the contract, literally."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{ss.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def texts():
    rng = random.Random(2)
    parts = ["password", "PassWd", "secret", "toKen", "token", "api_key", "APIKEY", " = ", ":", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "é", " ", "\n", "x.y=z", "AKIAAKIA", "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5", "the"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(500)] + ["", None, "word " * 5000 + "token=abcdefabcdef"]


def test_base_spans_match_the_plain_patterns(spark):
    rows = [(i, t, f"s{i % 5}", "clash", "clash") for i, t in enumerate(texts())] + [(3, "secret: 0123456789abcdef0", None, "", ""), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, hash string, spans string")
    got = secret_digests(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], hashlib.sha256(plain(r[1]).encode()).hexdigest()) for r in rows), key=str)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=str) == want


def test_ownership_decides_what_is_added(spark):
    mine, copied = "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5", "aGVsbG9Xb3JsZEhlbGxvV29ybGQx"
    rows = [(i, f"see {copied} here", f"o{i}") for i in range(6)] + [(10 + i, f"use {mine}", "o1") for i in range(6)]
    found = {r.doc_id: r for r in ss.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(not found[i].spans for i in range(6))
    assert all([(s.start, s.kind, s.end) for s in found[10 + i].spans] == [(4, 3, 4 + len(mine))] for i in range(6))
    counts = {r.n_owners: (r.n_found, r.n_repositories) for r in ss.ownership(ss.scanned(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert counts == {6: (6, 6), 1: (6, 6)}


def test_no_rows(spark):
    assert secret_digests(spark.createDataFrame([], "doc_id long, text string, source string")).agg(F.count("*")).first()[0] == 0


def test_copies_under_one_owner_are_copies(spark):
    """A value in many documents of one hot source is an example; one in few of them, and live, is not."""
    mine, example = "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5", "aGVsbG9Xb3JsZEhlbGxvV29ybGQx"
    rows = [(i, f"see {example} token={'x' * 12}", "hot") for i in range(60)] + [(100, f"use {mine} token=abcdefgh1234", "hot")]
    found = {r.doc_id: r for r in ss.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all([s.kind for s in found[i].spans] == [0] and (found[i].n_owner_specific, found[i].n_copied) == (0, 1) for i in range(60))
    assert [s.kind for s in found[100].spans] == [3, 0] and found[100].n_owner_specific == 2


def test_further_spans_are_linear_and_meet_no_base_span():
    import random
    import time

    dice = random.Random(4)
    token = lambda n: "".join(dice.choices("abcdefghijkLMNOPQRST0123456789+/", k=n))
    for _ in range(200):
        text = " ".join(dice.choice([token(24), f"token = {token(16)}", "AKIA" + "A1B2C3D4E5F6G7H8", "0123456789abcdef0123", f"{token(20)}=secret:{token(22)}", "word"]) for _ in range(dice.randint(0, 12)))
        base = ss.base_spans(text)
        free = [m for m in ss._TOKEN.finditer(text) if all(m.end() <= s or m.start() >= e for s, _, e, _ in base)]
        wanted = [m[0] for m in free if any(c.isdigit() for c in m[0]) and m[0].lower() != m[0] != m[0].upper() and ss._entropy(m[0]) >= ss.MIN_ENTROPY]
        assert [f[3] for f in ss.further_spans(text, base)] == wanted
    text = " ".join(f"token = {token(16)} {token(24)}" for _ in range(100_000))
    began = time.perf_counter()
    ss.further_spans(text, ss.base_spans(text))
    assert len(text) > 4_500_000 and time.perf_counter() - began < 20
