import hashlib
from collections import defaultdict

from plantpulse.llm.exact import exact_dedup


def norm(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def check(df, rows, **options):
    got = exact_dedup(df, **options).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    kept = defaultdict(list)
    for r in got:
        ids = groups[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert r["group_size"] == len(ids) and r["keep_id"] == best
        if r["kept"]:
            kept[r["text_sha256"]].append(r["doc_id"])
    assert {k: [max((i for i in v if i is not None), default=None)] for k, v in groups.items()} == dict(kept)


def test_odd_rows(documents, odd_rows):
    check(documents(odd_rows), odd_rows)


def test_slices_give_the_same_groups(documents):
    rows = [(i, f"Text {i % 37}") for i in range(400)] + [(1000 + i, f"alone {i}") for i in range(300)]
    check(documents(rows), rows)
    check(documents(rows), rows, max_cells=2048)


def test_crowded_filter_is_still_exact(documents):
    rows = [(i, f"Text {i % 90}") for i in range(300)]
    check(documents(rows), rows, cells_per_row=1, max_cells=64 * 1024)


def test_empty_and_clashing_columns(spark, documents):
    assert exact_dedup(documents([])).count() == 0
    df = documents([(1, "a"), (2, "A")]).selectExpr("*", "1 AS digest", "2 AS row", "3 AS keep_id", "4 AS slice")
    assert {(r["doc_id"], r["kept"]) for r in exact_dedup(df).collect()} == {(1, False), (2, True)}


def test_no_python_on_the_path(documents):
    plan = exact_dedup(documents([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
