from conftest import assert_same_bag, bag
from pyspark.sql import functions as F

from tideview.operators import bags, joins, terms
from tideview.sources.changes import apply_changes, changes_of, diff_snapshots, net_changes, split_changes
from tideview.sources.tables import key_violations, literal_rows

PAIR = "a int, b string"


def rows(spark, data, schema=PAIR):
    return literal_rows(spark, data, schema)


def test_bag_difference_is_except_all(spark):
    left = rows(spark, [(1, "x")] * 3 + [(None, None)] * 2 + [(2, "y"), (3, None)])
    right = rows(spark, [(1, "x"), (None, None), (4, "z"), (3, None), (3, None)])
    assert bag(bags.bag_difference(left, right)) == bag(left.exceptAll(right))
    assert bags.bag_difference(right, left).collect() == right.exceptAll(left).collect()


def test_bag_difference_of_a_row_with_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr(bags, "COPIES_PER_PIECE", 7)
    left = spark.range(100).select(F.when(F.col("id") < 40, 0).otherwise(F.col("id")).alias("a"))
    right = spark.createDataFrame([(0,)] * 3 + [(50,)], "a long")
    out = bags.bag_difference(left, right)
    assert_same_bag(out, left.exceptAll(right))
    assert out.where("a = 0").count() == 37


def test_deletes(spark):
    result = rows(spark, [(1, "x"), (1, "x"), (2, None), (None, None), (3, "z")])
    delta = rows(spark, [(1, "x"), (2, None), (None, None)])
    assert bag(bags.delete_matching(result, delta)) == ["(3, 'z')"]
    assert bag(bags.delete_bag(result, delta)) == ["(1, 'x')", "(3, 'z')"]
    assert bag(bags.delete_where_exists(result, delta, ["a"])) == ["(3, 'z')"]
    assert len(bag(bags.victims(result, delta, ["a"]))) == 4
    assert bags.insert_rows(result, delta.select("b", "a")).count() == 8
    assert bag(joins.restrict_to_keys(result, delta, ["a"])) == ["(1, 'x')", "(1, 'x')", "(2, None)"]


def test_verify_reports_both_kinds(spark):
    result, recomputed = rows(spark, [(1, "x"), (2, "y")]), rows(spark, [(1, "x"), (1, "x")])
    assert bag(bags.verify_view(result, recomputed)) == ["(1, 'x', 'missing')", "(2, 'y', 'stale')"]
    assert bags.verify_view(result, result).isEmpty()


def test_minimum_union(spark):
    data = [(1, 1, "both"), (1, None, "a"), (None, 1, "b"), (2, None, "a only"), (None, 3, "b only")]
    out = terms.remove_subsumed(rows(spark, data, "a int, b int, c string"), {"A": ["a"], "B": ["b"]})
    assert bag(out.select("c")) == ["('a only',)", "('b only',)", "('both',)"]


def test_minimum_union_of_six_tables_copies_only_labels_that_occur(spark):
    names = "abcdef"
    data = [tuple(range(1, 7)), (1, 2, None, None, None, None), (1, None, None, None, None, None), (9, 2, None, None, None, None), (9, None, None, None, None, None), (8, None, None, None, None, None)]
    given = rows(spark, data, ", ".join(f"{n} int" for n in names))
    out = terms.remove_subsumed(given, {n: [n] for n in names})
    assert bag(out) == sorted(map(repr, [data[0], data[3], data[5]]))
    # Two labels can be covered: two copies in the plan, not 62.
    assert out._jdf.queryExecution().analyzed().toString().count("struct(") == 2
    assert bag(terms.remove_subsumed(given, {n: [n] for n in names}, [{"a"}])) == sorted(map(repr, [data[0], data[1], data[3], data[5]]))  # only a alone may be covered


def test_null_variants_and_labels(spark):
    data = rows(spark, [(1, "x"), (2, None)])
    out = terms.null_variants(data, {"A": ["a"], "B": ["b"]}, [{"A"}, {"B"}, {"A", "B"}])
    assert bag(out) == sorted(map(repr, [(None, "x"), (1, None), (None, None), (None, None), (2, None), (None, None)]))
    assert out.schema == data.schema
    profile = terms.term_profile(data, {"A": ["a"], "B": ["b"]})
    assert bag(profile) == ["('A', 1)", "('A+B', 1)"]


def test_key_violations(spark):
    out = key_violations(rows(spark, [(1, "x"), (1, "x"), (2, None), (3, "y")]), ["a", "b"])
    assert bag(out) == ["(1, 'x', 2)", "(2, None, 1)"]


def test_diff_and_apply_are_inverse(spark):
    old = rows(spark, [(1, "x"), (2, "y"), (3, None), (4, "w")])
    new = rows(spark, [(1, "x"), (2, "changed"), (3, "set"), (5, "new")])
    feed = diff_snapshots(old, new, ["a"])
    assert bag(feed.select("op")) == ["('D',)", "('I',)", "('U',)", "('U',)"]
    assert_same_bag(apply_changes(old, *split_changes(feed), ["a"]), new)


def test_net_changes(spark):
    schema = "op string, before struct<a:int,b:string>, after struct<a:int,b:string>, seq long"
    history = [
        ("I", None, (1, "p"), 1), ("U", (1, "p"), (1, "q"), 2),  # comes
        ("I", None, (2, "p"), 3), ("D", (2, "p"), None, 4),  # comes and goes
        ("U", (3, "p"), (3, "q"), 5), ("U", (3, "q"), (3, "p"), 6),  # back to what it was
        ("D", (4, "p"), None, 7), ("I", None, (4, "q"), 8),  # an update in two steps
        ("U", (5, "p"), (6, "p"), 9), ("U", (6, "p"), (6, "q"), 10),  # another key
        ("D", (7, None), None, 11),
        ("U", (8, "p"), (9, "p"), 12), ("U", (9, "p"), (8, "p"), 13),  # away and back
    ]
    feed = spark.createDataFrame(history, schema)
    out = net_changes(feed, ["a"])
    got = {(r["op"], tuple(r["before"] or ()), tuple(r["after"] or ())) for r in out.collect()}
    assert got == {
        ("I", (), (1, "q")),
        ("U", (4, "p"), (4, "q")),
        ("D", (5, "p"), ()),
        ("I", (), (6, "q")),
        ("D", (7, None), ()),
    }


def test_changes_of(spark):
    feed = changes_of(rows(spark, [(1, "x")]), rows(spark, [(2, "y")]))
    deleted, inserted = split_changes(feed)
    assert bag(deleted) == ["(1, 'x')"] and bag(inserted) == ["(2, 'y')"]
