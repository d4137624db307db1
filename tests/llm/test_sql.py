"""Columns that SQL can express, of queries that it can't as a whole, over the driver's tables."""

import zlib

import duckdb
import pytest
from test_learned import water_fill

from feedprofile.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    return made


def test_mixing_sizes_and_targets(spark, con):
    got = {r["doc_id"]: r for r in QUERIES["op1_mixing"](spark, SF_DIR).collect()}
    rows = con.execute(f"SELECT doc_id, source, len({WORDS}) AS n, sum(len({WORDS})) OVER (PARTITION BY source)::bigint AS total FROM documents").fetchall()
    order = sorted({s for _, s, _, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _, _ in rows) else [])
    size = {s: total for _, s, _, total in rows}
    target = dict(zip(order, water_fill([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    assert len(got) == len(rows)
    for k, s, n, total in rows:
        assert (got[k]["size"], got[k]["source_size"]) == (n, total) and got[k]["target"] == pytest.approx(target[s], rel=1e-9)
    for s in order:
        assert abs(sum(got[k]["taken"] for k, t, _, _ in rows if t == s) - target[s]) <= max(min(n for _, t, n, _ in rows if t == s), 0.005 * target[s])


def test_personal_data_counts(spark, con):
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    odd, even = "(d[i]::int)", "(2 * d[i]::int - CASE WHEN d[i]::int > 4 THEN 9 ELSE 0 END)"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: list_transform([reverse({digits})], lambda d: CASE WHEN i % 2 = 1 THEN {odd} ELSE {even} END)[1]))"
    rows = con.execute(rf"""SELECT doc_id,
      len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')),
      len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::hugeint)) <= 255)),
      len(list_filter(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn} % 10 = 0 ELSE false END)),
      len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({digits}) BETWEEN 9 AND 15))
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""").fetchall()
    got = {tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")) for r in QUERIES["op4_personal_data"](spark, SF_DIR).collect()}
    assert got == set(rows) and sum(sum(r[1:]) for r in rows) > 0


def test_lm_base_columns(spark, con):
    got = {r["doc_id"]: r for r in QUERIES["op6_lm_scoring"](spark, SF_DIR).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 1) for k, r in got.items())
    learned = ", ".join(str(k) for k, r in got.items() if not r["held_out"])
    rows = con.execute(f"""WITH tokens AS (SELECT doc_id, unnest(list_append({WORDS}, ' end')) AS w FROM documents),
      counts AS (SELECT w, count(*) AS c FROM tokens WHERE doc_id IN ({learned}) GROUP BY w), sums AS (SELECT sum(c)::bigint AS n, count(*) AS v FROM counts)
      SELECT doc_id, count(*), count(c), any_value(n), sum(log10((coalesce(c, 0) + 0.5::double) / (n + 0.5::double * (v + 1))))
      FROM tokens LEFT JOIN counts USING (w), sums GROUP BY doc_id""").fetchall()
    assert len(rows) == len(got)
    for k, tokens, known, total, base in rows:
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, total) and r["base_score"] == pytest.approx(base, rel=1e-9)
