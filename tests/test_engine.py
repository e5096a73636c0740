"""Registry, pipelines, scanner, statistics, cleaner, sources, streams, and queries against DuckDB."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from textloom.operators import relational, scan, stats
from textloom.operators.registry import GROUPS, OPS, Op, conflicts_with, default_enabled, default_params, register_op
from textloom.plans import cleaner, queries
from textloom.plans.pipeline import run_pipeline
from textloom.sources import text as sources
from textloom.streaming import stream

AWKWARD = ["", " ", "\n\n\n", "a", "\U0001f468‍\U0001f469", "<p>", "&#;", "a" * 5000, "\x00\x07\xad"]
SAMPLES = AWKWARD + ["“A”  b , c\n\n\n\n• d\n12\n> e", "PDF line that is cut\nright here and goes\non for a bit.\n\n\nNext."]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def texts(df):
    return [r["text"] for r in df.orderBy("id").collect()]


def test_registry():
    assert len(OPS) == 58 and {op.group for op in OPS.values()} == set(GROUPS) and len(default_enabled()) == 14
    groups = [op.group for op in OPS.values()]
    first_of_format = groups.index("format")
    assert [g for g, _ in itertools.groupby(groups[:first_of_format])] == list(GROUPS[:-1])
    assert conflicts_with("curlQuotes", OPS) == ["straightenQuotes"] and conflicts_with("nope", OPS) == []
    assert default_params()["wrapLines"] == {"width": 80, "breakLongWords": False}


def test_every_op_gives_text_on_awkward_input(spark):
    for ids in itertools.batched(OPS, 20):
        df = frame(spark, AWKWARD)
        for i in ids:
            df = df.withColumn(i, OPS[i].run(F.col("text"), **OPS[i].params))
        for row in df.collect():
            assert all(isinstance(row[i], str) for i in ids), row


def test_pipeline_order_errors_and_unknown_ids(spark):
    df = frame(spark, ["B\r\na"])
    out = run_pipeline(df, ["trimDocument", "changeCase", "removeCharacters", "nope"], {"changeCase": {"mode": "upper"}, "removeCharacters": {"characters": "z-a"}}, errors="errors")
    row = out.first()
    assert row["text"] == "B\nA" and [e["id"] for e in row["errors"]] == ["removeCharacters"]
    assert texts(run_pipeline(frame(spark, [None]), [])) == [""]


def test_register_op(spark):
    register_op(Op("testShout", "format", lambda t: F.concat(t, F.lit("!"))))
    try:
        assert texts(run_pipeline(frame(spark, ["a "]), ["testShout", "trimDocument"])) == ["a!"]
        with pytest.raises(ValueError):
            register_op(Op("testShout", "format", F.upper))
    finally:
        del OPS["testShout"]


def test_conflicting_column_names_survive(spark):
    df = frame(spark, [" a "]).withColumn("pos", F.lit(1)).withColumn("line", F.lit("x"))
    assert cleaner.clean(df).first().asDict() == {"id": 0, "text": "a", "pos": 1, "line": "x"}


def test_scan(spark):
    rows = scan.scan_long(frame(spark, ["“a”  b\xa0c ,\n12\nH\nH\nH\n• x\n<p>&amp;\U0001f600", "clean text."]).withColumnRenamed("id", "key"), "key").collect()
    got = {r["id"]: r["count"] for r in rows if r["key"] == 0}
    assert got.pop("hardWrap") == 1
    assert got == {"html": 1, "nbsp": 1, "entities": 1, "pageNumbers": 1, "runningHeads": 3, "smartQuotes": 2, "bullets": 1, "duplicateLines": 2, "multiSpace": 1, "spaceBeforePunctuation": 1, "emoji": 1}
    assert not [r for r in rows if r["key"] == 1]
    order = [(scan.SEVERITIES.index(r["severity"]), -r["count"]) for r in sorted((r for r in rows if r["key"] == 0), key=lambda r: r["position"])]
    assert order == sorted(order)


def test_reported_problems_are_reduced_by_their_ops(spark):
    df = frame(spark, ["“a”  b\xa0c ,\n 12 \nH\nH\nH\n• x\n<p>&amp;\U0001f600 \n\n\n\nﬁ\xad—\ttail "])
    before = df.select(scan.counts_of(F.col("text")).alias("c")).first()["c"].asDict()
    for check, _, ops, _ in scan.CHECKS:
        if before[check]:
            for op in ops.split():
                after = run_pipeline(df, [op]).select(scan.counts_of(F.col("text"), [check]).alias("c")).first()["c"][check]
                if after < before[check]:
                    break
            else:
                raise AssertionError(check)


def test_inspect_characters(spark):
    rows = scan.inspect_characters(frame(spark, ["\xa0b\xa0‍\U0001f600z", ""]), "id").orderBy("rank").collect()
    assert [(r["label"], r["count"], r["name"], r["printable"]) for r in rows] == [
        ("U+00A0", 2, "no-break space", False), ("U+200D", 1, "zero-width joiner", False), ("U+1F600", 1, "emoji or pictograph", True)
    ]


def test_marked(spark):
    pieces = frame(spark, ["a b\tc\xa0\u200b\xe9\n"]).select(scan.marked(F.col("text")).alias("m")).first()["m"]
    assert [(m["kind"], m["text"]) for m in pieces] == [("plain", "a b"), ("tab", "\t"), ("plain", "c"), ("space", "\xa0"), ("invisible", "U+200B"), ("other", "\xe9"), ("plain", "\n")]
    assert pieces[4]["title"] == "zero-width space (U+200B)" and pieces[0]["title"] is None


def test_stats(spark):
    s = frame(spark, ["Hello world.\n\nSecond paragraph here.", "", None]).select(stats.compute_stats(F.col("text")).alias("s")).collect()
    assert [s[0]["s"][k] for k in ("words", "paragraphs", "lines", "sentences", "characters", "charactersNoSpaces")] == [5, 2, 3, 2, 36, 31]
    assert all(set(r["s"].asDict().values()) == {0} for r in s[1:])
    rows = stats.word_frequency(frame(spark, ["The cat, the Cat. dog. -dog- a"]), "id").collect()
    assert [(r["word"], r["count"]) for r in sorted(rows, key=lambda r: r["rank"])] == [("cat", 2), ("dog", 2)]
    f = spark.sql("select 0.0d a, 0.4d b, 12.6d c, 125.2d d, 9999 e, 12345 f, 2000000 g, 500 h, 1536 i, 3145728 j").select(
        *map(stats.format_duration, "abcd" and [F.col(c) for c in "abcd"]), *[stats.format_count(F.col(c)) for c in "efg"], *[stats.format_bytes(F.col(c)) for c in "hij"]
    )
    assert list(f.first()) == ["0 sec", "24 sec", "13 min", "2 hr 5 min", "9,999", "12.3k", "2M", "500 B", "1.5 KB", "3.0 MB"]


def described(spark, raw, **options):
    df = frame(spark, [raw]).withColumn("raw", F.col("text"))
    out = cleaner.clean(df, options)
    return out.select(F.array_join(cleaner.describe_changes(F.col("raw"), F.col("text"), options), " ").alias("s")).first()["s"]


def test_describe_changes(spark):
    assert described(spark, "Say\xa0“hi”.") == "Fixed 1 non-breaking space and 2 curly quotes."
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    uk = "\U0001f1ec\U0001f1e7"
    assert described(spark, f"Party \U0001f389 with the {family} {uk}", removeEmojis=True) == "Removed 3 emojis."
    assert described(spark, "") == "" and described(spark, "clean.") == ""
    many = "a\xa0b​c—d“e  f ﬁ x \x07y"
    assert "other fixes." in described(spark, many)


def test_suggestions(spark):
    df = frame(spark, ["a line that goes on and on to\nthe next line and then it\nstops here at last.", "<p>x</p>", "fine.", ""])
    ids = lambda o: [[x["id"] for x in r["s"]] for r in df.select("id", cleaner.suggestions(F.col("text"), o).alias("s")).orderBy("id").collect()]
    assert ids(None) == [["joinLines"], ["stripHtml"], [], []]
    assert ids({"joinLines": True, "stripHtml": True, "unknown": 1}) == [[], [], [], []]


def test_cleaning_again_changes_nothing(spark):
    """No, one and all options, on text without lines of only spaces (which the first pass empties but does not collapse)."""
    df = frame(spark, ["“Hi”,  he said .\n\n\n• one\n• two\n12\n> quoted\nThis line was bro-\nken here and runs on.\n\U0001f600 ok"])
    names = [f for f in cleaner.CleanOptions.__dataclass_fields__]
    for bits in itertools.product([False, True], repeat=len(names)):
        options = dict(zip(names, bits, strict=True))
        if sum(bits) not in (0, 1, len(names)):
            continue
        once = cleaner.clean(df, options)
        row = cleaner.clean(once.withColumn("once", F.col("text")), options).first()
        assert row["text"] == row["once"], options


def test_tools_and_steps(spark):
    steps = [{"id": "dedupe"}, {"id": "nope"}, {"id": "stripHtml"}, {"id": "replace", "params": {"find": "a", "replace": "x"}}, {"id": "sort"}]
    assert texts(cleaner.apply_steps(frame(spark, ["b\na\nB\n<p>"]), steps)) == ["<p>\nb\nx"]
    assert texts(cleaner.apply_steps(frame(spark, ["caf\xe9 “x” — \U0001f600 €"]), [{"id": "ascii"}])) == ['cafe "x" - EUR']


def test_relational_forms_agree(spark):
    df = frame(spark, ["b\na\nB\n\n\na ", "", "x"])
    back = relational.implode_lines(relational.explode_lines(df, "id"), "id")
    assert texts(back) == texts(df)
    once = relational.implode_lines(relational.deduplicated(relational.explode_lines(df, "id"), "id"), "id")
    assert texts(once) == texts(run_pipeline(df, ["deduplicateLines"]))
    assert [tuple(r) for r in relational.frequent_lines(frame(spark, ["a\na", "a", "b"]), "id").collect()] == [("a", 2, 3)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>h\xe9</p>", encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_bytes(b"x\xffy" + b"z" * 100)
    rows = {os.path.basename(r["path"]): r for r in sources.read_files(spark, str(tmp_path / "in"), max_bytes=50).collect()}
    assert rows["a.html"]["text"] == "<p>h\xe9</p>" and rows["a.html"]["is_html"] and rows["b.txt"]["text"] is None
    df = frame(spark, ["a", "b"])
    for kind in ("parquet", "json", "orc"):
        sources.write_table(df, str(tmp_path / kind), kind)
        assert sorted(r["text"] for r in sources.read_table(spark, str(tmp_path / kind), kind).collect()) == ["a", "b"]
    sources.write_texts(df, str(tmp_path / "plain"))
    assert sorted(r["text"] for r in sources.read_lines(spark, str(tmp_path / "plain")).collect()) == ["a", "b"]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, " a  b ", "2024-01-01 00:00:00"), (2, "“c”", "2024-01-01 00:07:00")], "id long, text string, at string")
    df.withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    source = stream.read_stream(spark, str(tmp_path / "in"), schema)
    stream.write_stream(stream.scan_stream(stream.clean_stream(source)), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert texts(spark.read.parquet(str(tmp_path / "out"))) == ["a b", '"c"']
    counts = stream.windowed_stats(stream.read_stream(spark, str(tmp_path / "in"), schema), "at")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["documents"], r["words"]) for r in spark.sql("select * from counts").collect()) == [(1, 1), (1, 2)]


def test_plan_of_the_default_clean(spark):
    plan = cleaner.clean(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["clean_default", "op_fixMojibake", "op_curlQuotes", "op_deduplicateLines", "op_htmlToText", "scan_long", "doc_stats", "word_frequency", "urls_without_tracking", "op_extract"])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    close = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert close(tuple(r) for r in got.select(*columns).collect()) == close(want)


def test_queries_do_not_need_the_training_data_folder():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
