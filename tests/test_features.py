import json

import pytest
from pyspark.sql import functions as F

from terrane.functions.columns import first_row_per_key, left_join_suffixed, strict_rename
from terrane.functions.skew import collect_in_parts
from terrane.operators.features import NAME_FIELDS, names_array, ndm_attributes

NAMES = (
    "FEATURE_ID bigint, UNPARSED_FULL_NAME string, UNPARSED_NAME string, LANGUAGE string, NAME_TYPE string, "
    "CODE_TYPE string, NAME_RANK int, LOCALE_LIST_USE string"
)


def name(key, full, rank=1, language='["en"]'):
    return (key, full, None, language, "T", None, rank, "U")


def test_names_are_ordered_json_with_nulls(spark):
    df = spark.createDataFrame([name(1, "b", 2), name(1, "a", 2), name(1, "c", 1), name(2, "d")], NAMES)
    found = {r["FEATURE_ID"]: r for r in names_array(df).collect()}
    records = json.loads(found[1]["NAMES_ARRAY"])
    assert [r["UNPARSED_FULL_NAME"] for r in records] == ["c", "a", "b"]
    assert list(records[0]) == NAME_FIELDS
    assert records[0]["CODE_TYPE"] is None and records[0]["LANGUAGE"] == "en"
    assert found[1]["NAMES_PART"] == 0


@pytest.mark.parametrize("text, first", [('["fr","en"]', "fr"), ("[]", None), (None, None), ("not json", None)])
def test_first_language(spark, text, first):
    df = spark.createDataFrame([name(1, "a", language=text)], NAMES)
    assert json.loads(names_array(df).head()["NAMES_ARRAY"])[0]["LANGUAGE"] == first


def test_hot_feature_keeps_every_name(spark):
    """A third of all names on one feature, half of those copies of one name."""
    rows = [name(7, f"n{i}" if i % 2 else "same", i % 5) for i in range(600)] + [name(i % 90 + 100, f"x{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, NAMES).repartition(6)
    whole = {r["FEATURE_ID"]: r["NAMES_ARRAY"] for r in names_array(df).collect()}
    parts = names_array(df, cell_items=50).collect()
    hot = [json.loads(r["NAMES_ARRAY"]) for r in parts if r["FEATURE_ID"] == 7]
    assert len(hot) > 10 and max(map(len, hot)) <= 50
    key = lambda r: json.dumps(r)
    assert sorted((r for p in hot for r in p), key=key) == sorted(json.loads(whole[7]), key=key)
    numbers = [r["NAMES_PART"] for r in parts if r["FEATURE_ID"] == 7]
    assert min(numbers) == 0 and len(set(numbers)) == len(numbers)
    # The order goes on from part to part.
    in_order = [n for _, p in sorted(zip(numbers, hot), key=lambda x: x[0]) for n in p]
    ordered = [(n["NAME_RANK"], json.dumps(n, separators=(",", ":"))) for n in in_order]
    assert ordered == sorted(ordered)
    assert {r["FEATURE_ID"]: r["NAMES_ARRAY"] for r in parts if r["FEATURE_ID"] != 7} == {
        k: v for k, v in whole.items() if k != 7
    }


def test_parts_of_null_and_compound_keys(spark):
    df = spark.range(60).select(
        F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"), F.lit(1).alias("j"), (F.col("id") % 7).alias("v")
    )
    found = collect_in_parts(df, ["k", "j"], limit=4).collect()
    for key in ("a", None):
        values = sorted(i["v"] for r in found if r["k"] == key for i in r["items"])
        assert values == sorted(i % 7 for i in range(60) if (i % 2 == 0) == (key == "a"))
    assert all(len(r["items"]) <= 4 for r in found)


NDM = (
    "FEATURE_ID bigint, FEATURE_PROTO string, METADATA string, X_EDITS string, REPRESENTATIVE_POINT string, "
    "LENGTH int, AREA int, PERIMETER int, OTHER string"
)


PAYLOAD = ["FEATURE_PROTO", "METADATA", "X_EDITS"]


def test_ndm_columns(spark):
    df = spark.createDataFrame([(1, "{}", "m", "e", "p", 1, 2, 3, "o"), (None, "{}", "m", "e", "p", 1, 2, 3, "o")], NDM)
    found = ndm_attributes(df, PAYLOAD)
    assert found.columns == ["FEATURE_ID", "FEATURE_PROTO", "METADATA", "X_EDITS", "LENGTH_NDM", "AREA_NDM", "PERIMETER_NDM", "OTHER"]
    rows = {r["FEATURE_ID"]: r for r in found.collect()}
    assert rows[1]["LENGTH_NDM"] == 1
    assert rows[None]["LENGTH_NDM"] is None and rows[None]["METADATA"] == "m"
    paired = ndm_attributes(df, PAYLOAD, pair_duplicates=True)
    assert paired.columns == found.columns
    assert sorted(map(str, paired.collect())) == sorted(map(str, found.collect()))


def test_ndm_duplicates_can_be_paired(spark):
    df = spark.createDataFrame([(1, "{}", "m", "e", "p", 1, 2, 3, "o")] * 3, NDM)
    assert ndm_attributes(df, PAYLOAD).count() == 3
    assert ndm_attributes(df, PAYLOAD, pair_duplicates=True).count() == 9


def test_ndm_without_measures_is_an_error(spark):
    df = spark.createDataFrame([(1, "{}", "m")], "FEATURE_ID bigint, FEATURE_PROTO string, METADATA string")
    with pytest.raises(ValueError, match="AREA, LENGTH, PERIMETER"):
        ndm_attributes(df, PAYLOAD[:2])


def test_ndm_payload_is_strict(spark):
    df = spark.createDataFrame([(1, "{}", "m", "e", "p", 1, 2, 3, "o")], NDM)
    with pytest.raises(ValueError, match="Y_EDITS"):
        ndm_attributes(df, [*PAYLOAD, "Y_EDITS"])
    found = ndm_attributes(df, ["METADATA"])  # other columns that look like a payload are attributes
    assert found.columns == ["FEATURE_ID", "METADATA", "FEATURE_PROTO", "X_EDITS", "LENGTH_NDM", "AREA_NDM", "PERIMETER_NDM", "OTHER"]


def test_strict_rename(spark):
    with pytest.raises(ValueError, match="nope"):
        strict_rename(spark.range(1), {"nope": "x"})


def test_suffix_only_where_names_clash(spark):
    left = spark.createDataFrame([(1, "a", 2), (None, "b", 3)], "FEATURE_ID bigint, Name string, x int")
    right = spark.createDataFrame([(1, "z", 5), (None, "y", 6)], "FEATURE_ID bigint, NAME string, y int")
    joined = left_join_suffixed(left, right, "FEATURE_ID", "_GEOMETRY")
    assert joined.columns == ["FEATURE_ID", "Name", "x", "NAME_GEOMETRY", "y"]
    assert {tuple(r) for r in joined.collect()} == {(1, "a", 2, "z", 5), (None, "b", 3, None, None)}
    safe = left_join_suffixed(left, right, "FEATURE_ID", "_GEOMETRY", null_safe=True)
    assert (None, "b", 3, "y", 6) in {tuple(r) for r in safe.collect()}
    with pytest.raises(ValueError, match="already exists"):
        left_join_suffixed(joined, right, "FEATURE_ID", "_GEOMETRY")


def test_first_row_comes_from_one_row(spark):
    df = spark.createDataFrame(
        [(1, None, "z"), (1, 5, "a"), (2, 9, None), (2, 3, "q")], "FEATURE_ID bigint, a int, b string"
    ).withColumn("m", F.create_map(F.lit("k"), F.col("b")))
    rows = {r["FEATURE_ID"]: r for r in first_row_per_key(df, "FEATURE_ID").collect()}
    assert (rows[1]["a"], rows[1]["b"], rows[1]["m"]) == (None, "z", {"k": "z"})
    assert (rows[2]["a"], rows[2]["b"]) == (3, "q")
    ordered = {r["FEATURE_ID"]: r["b"] for r in first_row_per_key(df, "FEATURE_ID", ["b"]).collect()}
    assert ordered == {1: "a", 2: None}
