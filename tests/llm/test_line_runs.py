import random

from plantpulse.llm.line_runs import LineRuns, line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain(rows, least=10):
    first = {}
    for i, text in rows:
        if i is not None and text is not None:
            for line in text.split("\n"):
                k = key(line)
                if len(k) >= least:
                    first[k] = min(first.get(k, i), i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < least or first.get(key(x), i) >= i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(
        [(r["doc_id"], r["lines"]["n_lines"], r["lines"]["n_dropped"], r["lines"]["kept"])
         for r in line_dedup(df, **options).collect()], key=repr,
    )


def test_odd_rows(documents, odd_rows):
    assert got(documents(odd_rows)) == plain(odd_rows)


def test_random_lines_in_any_number_of_batches(documents):
    rng = random.Random(1)
    pool = [f"{rng.choice(['A', 'a'])} shared line {i}{' ' * rng.randint(0, 2)}" for i in range(60)] + ["short", ""]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 8)))) for i in range(120)]
    want = plain(rows)
    for options in ({}, {"batches": 1}, {"batches": 9, "fanout": 3}):
        assert got(documents(rows), **options) == want


def test_runs_are_merged_by_levels(spark):
    runs = LineRuns(spark, fanout=2)
    for i in range(7):
        keys = spark.createDataFrame([(bytes([i, j]),) for j in range(3)], "key binary")
        assert runs.unseen(keys).count() == 3
        runs.add(runs.table(keys))
        assert runs.unseen(keys).count() == 0
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    names = [name for level in runs.levels for name in level]
    assert sorted(spark.table(n).count() for n in names) == [3, 6, 12]
    runs.clear()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_empty_and_clashing_columns(documents):
    assert line_dedup(documents([])).count() == 0
    rows = [(1, "a line that two documents hold"), (2, "A line that two documents hold \nown")]
    df = documents(rows).selectExpr("*", "1 AS _lines", "2 AS lines", "3 AS `key`", "4 AS at", "5 AS _drop_at")
    out = line_dedup(df, out="report")
    assert out.columns == [*df.columns, "report"]
    assert {(r["doc_id"], r["report"]["kept"]) for r in out.collect()} == {(1, rows[0][1]), (2, "own")}


def test_runs_lie_in_the_scratch_folder_and_go_after_a_failure(spark, documents, monkeypatch):
    from plantpulse.session import checkpoint_root

    runs = LineRuns(spark)
    name = runs.table(spark.createDataFrame([(b"x",)], "key binary"))
    assert spark.table(name).inputFiles()[0].removeprefix("file:").lstrip("/").startswith(checkpoint_root(spark).lstrip("/"))
    runs.clear()
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(LineRuns, "add", lambda self, run: 1 / 0)
    try:
        line_dedup(documents([(1, "a line that is long enough"), (2, "a line that is long enough")]))
    except ZeroDivisionError:
        pass
    assert {t.name for t in spark.catalog.listTables()} == before
