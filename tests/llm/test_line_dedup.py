import hashlib

from threadloom.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, source string, h long, row string"


def brute(rows, least=5):
    sites = {}
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for _, text, site, *_ in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(strip(line), set()).add(site)
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        bad = [bool(strip(x)) and len(sites[strip(x)]) >= least for x in lines]
        out.append((d, None if text is None else "\n".join(x for x, b in zip(lines, bad) if not b), sum(bool(strip(x)) for x in lines), sum(bad)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = [(i, "\n".join([f"line {i}", f" shared by {i % 4} " if i % 4 else "everywhere", "", "two sites" if i % 10 < 2 else "x" * (i % 3)]), f"s{i % 10}", 1, "r") for i in range(300)]
    rows += [(900 + k, f"spread {n}", f"t{k}" if k else None, 0, "") for n in (3, 4, 5, 6, 20) for k in range(n)]
    rows += [(1000, None, "s", 0, ""), (1001, "", None, 0, ""), (5, rows[5][1], rows[5][2], 0, ""), (None, "everywhere\n\nmine", "s1", 0, ""), (1002, "long " * 100_000, "s", 0, "")]
    got = sorted(map(tuple, ld.without_spread_lines(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_no_rows(spark):
    assert ld.without_spread_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_agrees(spark, tmp_path):
    import duckdb

    from threadloom.llm.registry import op8_line_dedup

    rows = [(i, f"a{i % 3}\n b \n\nc{i}\n{'d' if i < 4 else 'e'}", f"s{i % 7}", i, "r") for i in range(60)] + [(99, None, None, 0, ""), (100, "", "s", 0, "")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(ld.SQL).fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text_sha256) for r in op8_line_dedup(spark, str(tmp_path)).collect())
    assert got == want and hashlib.sha256(b"").hexdigest() in {r[3] for r in got}
