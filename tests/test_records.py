"""Records without a schema."""

import json
from collections import Counter

from pyspark.sql import functions as F

from feedprofile.sources import records

RECORDS = [{"id": 1, "gender": "m", "x": [1, "a", {"y": None}]}, {"id": "2", "gender": None}, {"id": 2.5, "x": {"y": True, "z": {"u": [[]]}}}, [1, {"id": 3}], "text", 7, None, {}]


def paths(value, at, depth):
    name = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    yield at, name
    if depth and isinstance(value, dict):
        for k, v in value.items():
            yield from paths(v, f"{at}.{k}", depth - 1)
    if depth and isinstance(value, list):
        for v in value:
            yield from paths(v, f"{at}[]", depth - 1)


def written(spark, tmp_path):
    (tmp_path / "r").write_text("\n".join(["", *map(json.dumps, RECORDS), "{broken", '{"id": 1} tail', "  "]) + "\n")
    return records.read_records(spark, str(tmp_path / "r"))


def test_paths_and_types(spark, tmp_path):
    rows = written(spark, tmp_path)
    assert rows.count() == len(RECORDS) + 2 and rows.where("record IS NULL").count() == 1
    for depth in (0, 1, 4):
        got = {(r["path"], r["type"]): r["n"] for r in records.key_types(rows, depth).collect()}
        assert got == Counter(p for r in [*RECORDS, {"id": 1}] for p in paths(r, "$", depth))
    assert records.key_types(rows.limit(0)).count() == 0


def test_fields_schema_and_keys(spark, tmp_path):
    rows = written(spark, tmp_path)
    got = rows.select(records.field("$.id", "long").alias("id"), records.field("$.x[2].y", "string").alias("y"), records.field("$.x.y", "boolean").alias("b")).collect()
    assert [r["id"] for r in got[:3]] == [1, 2, 2] and got[2]["b"] is True and got[0]["y"] is None and got[3]["id"] is None
    objects = rows.where("is_variant_null(record) = false AND record IS NOT NULL AND startswith(line, '{')")
    assert "gender: STRING" in records.common_schema(objects) and "id: VARIANT" in records.common_schema(objects)
    other = {r["line"] for r in records.with_other_keys(rows, ("gender", "id")).collect()}
    assert json.dumps(RECORDS[1]) not in other and len(other) == len(RECORDS) - 1 + 2
    assert records.with_other_keys(rows.where(F.col("line") == json.dumps(RECORDS[0])), ("id", "x", "gender")).count() == 0
