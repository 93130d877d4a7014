"""Evidence joins, region sets, voice windows, report figures and documents on small tables made here."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import evidence as ev
from tidemark.operators import reports as rp
from tidemark.operators import threads as th
from tidemark.sources import documents as docs

SPAN = "media_id long, start double, end double"
ROWS = "media_id long, pos int, start double, end double, text string"


def told(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_voice_window(spark):
    silences = spark.createDataFrame([(1, 0.0, 12.54), (1, 53.0, 60.0), (2, 0.0, 60.0), (4, None, 3.0), (5, 0.0, 0.95), (5, 1.0, 60.0)], SPAN)
    media = spark.createDataFrame([(1, 60.0, None), (2, 60.0, False), (3, 60.0, None), (4, 10.0, None), (5, 60.0, None), (6, 60.0, True)], "media_id long, duration double, broken boolean")
    got = {r[0]: r[1:] for r in told(ev.voice_window(silences, media, failed="broken"))}
    assert got[1] == pytest.approx((12.44, 53.15 - 12.44))
    assert got[2] == (None, None) and got[5] == (None, None)  # all silent; a voice of 0.05 s is none
    assert got[3] == (0.0, 60.0) and got[4] == (0.0, 10.0) and got[6] == (0.0, 60.0)
    assert ev.voice_window(silences, media.where("false")).count() == 0


def test_snapped_to_voice(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 5.0, "a"), (1, 1, 5.0, 99.0, "b"), (1, 2, 6.0, 7.0, " "), (2, 0, 0.05, 2.0, "c"), (2, 1, 3.0, 4.0, None), (3, 0, 0.0, 1.0, "d")], ROWS)
    windows = spark.createDataFrame([(1, 3.0, 60.0), (2, 1.9, 60.0), (3, 5.0, 60.0)], "media_id long, voice double, duration double")
    # the third row would begin after its end, and goes
    assert told(ev.snapped_to_voice(rows, windows)) == [(1, 0, 3.0, 5.0, "a"), (1, 1, 5.0, 60.0, "b"), (2, 0, 0.05, 2.0, "c")]


def test_texts_beside(spark):
    left = spark.createDataFrame([(1, 0, 10.0, 12.0, "x"), (1, 1, 500.0, 501.0, "y"), (2, 0, None, 1.0, "z"), (3, 0, 9.0, 8.0, "w")], ROWS)
    other = spark.createDataFrame([(1, n, 8.0 + n, 9.25 + n, f"t{n}") for n in range(8)] + [(2, 0, 0.0, 1.0, "n"), (1, 9, None, None, "q")], ROWS)
    got = {(r[0], r[1]): r[2] for r in told(ev.texts_beside(left, other, 0.75, closed=True, first=4, separator=" / ", missing="-", width=1.0).select("media_id", "pos", "beside"))}
    assert got == {(1, 0): "t0 / t1 / t2 / t3", (1, 1): "-", (2, 0): "-", (3, 0): "-"}
    # 9.25 touches 10.0 - 0.75, which counts only where bounds do
    strict = ev.texts_beside(left, other, 0.75, width=1.0).where("media_id = 1 and pos = 0").first()["beside"]
    assert strict == "t1t2t3t4"
    assert ev.texts_beside(left, other.where("false"), 1.0).where("beside is not null").count() == 0


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_pairs_do_not_depend_on_bins(spark, width):
    rows = spark.createDataFrame([(1, n, n * 1.5, n * 1.5 + (40.0 if n % 7 == 0 else 1.0), "t") for n in range(30)], ROWS)
    got = {(r.pos, r.r_pos) for r in ev.near_pairs(rows, rows, 0.5, width=width).select("pos", "r_pos").collect()}
    every = rows.collect()
    assert got == {(a.pos, b.pos) for a in every for b in every if b.end > a.start - 0.5 and b.start < a.end + 0.5}
    assert ev.near_pairs(rows, rows, 0.5, width=width).count() == len(got)


def test_places(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 2.0, "a"), (1, 1, 2.5, 9.0, "b"), (2, 0, 0.0, 1.0, "c")], ROWS)
    times = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 2.0), (1, 2.0), (1, 3.0), (1, None)], "media_id long, t double")
    assert told(ev.places(rows, times)) == [(1, 0, 1, 4), (1, 1, 4, 5), (2, 0, 0, 0)]


def test_unrepeated_and_regions(spark):
    original = spark.createDataFrame([(1, 0, 0.0, 1.0, "hi"), (1, 1, 2.0, 3.0, "yes")], ROWS)
    repairs = spark.createDataFrame([(1, 0, 0.5, 1.5, " hi "), (1, 1, 1.0, 1.5, "hi"), (1, 2, 2.5, 2.6, "no"), (2, 0, 0.0, 1.0, "hi")], ROWS)
    assert [r[:2] for r in told(ev.unrepeated(repairs, original))] == [(1, 1), (1, 2), (2, 0)]
    a = spark.createDataFrame([(1, 0.0, 4.0), (1, 3.0, 6.0), (1, 8.0, 8.0), (2, 0.0, 1.0), (3, None, 1.0)], SPAN)
    b = spark.createDataFrame([(1, 2.0, 3.5), (1, 3.5, 5.0), (1, 6.0, 9.0)], SPAN)
    assert told(ev.region_sets(a, b)) == [(1, 2.0, 5.0)]
    assert told(ev.region_sets(a, b, "difference")) == [(1, 0.0, 2.0), (1, 5.0, 6.0), (2, 0.0, 1.0)]
    with pytest.raises(ValueError):
        ev.region_sets(a, b, "sum")


def test_relocated(spark):
    entries = spark.createDataFrame([(1, "a", "A", "k1"), (2, "b", None, None), (3, "c", "C", "k9"), (4, "", None, "")], "entry_id long, source string, canonical_source string, cache_key string")
    files = spark.createDataFrame([("z", "y", "k1", "p1"), ("b", "b", None, "p3"), ("b", None, "k3", "p2"), ("", "C", "", "p4")], "source string, identity string, cache_key string, path string")
    assert {r.entry_id: r.path for r in ev.relocated(entries, files).collect()} == {1: "p1", 2: "p2", 3: "p4", 4: None}


def test_figures(spark):
    one = spark.range(1)
    c = lambda *v: one.select(ev.fusion_confidence(*map(F.lit, v))).first()[0]
    assert c(0, 5, 0, 0) == 1.0 and c(0, 0, 8, 10) == 0.3 and c(1, 2, 5, 10) == pytest.approx(0.5)
    sizes = spark.createDataFrame([("a/b/x", 5), ("a/y", 2), ("z", 9)], "path string, length long")
    assert told(rp.folder_bytes(sizes)) == [("a", 2, 7), ("a/b", 1, 5)]
    breaks = one.select(rp.break_set(F.array(*map(F.lit, (5, 2, 2, 0, 9, -1))), F.lit(9)).alias("b")).first()["b"]
    assert breaks == [2, 5]
    marks = F.array(F.lit(0), F.lit(1), F.lit(4))  # of "ab, c." without its punctuation
    after = lambda n: one.select(rp.after_boundary(F.lit("ab, c."), marks, F.lit(n)), rp.punctuated(F.lit("ab, c."), marks, F.lit(n), ",.")).first()
    assert [tuple(after(n)) for n in range(4)] == [("", False), ("", False), (", ", True), (".", True)]


def test_captions_and_objects(spark):
    rows = spark.createDataFrame([("[0.0 --> 1.0]  hello ",), ("whisper_init: x",), ("  plain ",), (None,), ("",)], "x string")
    assert [r[0] for r in rows.select(tx.caption(F.col("x"))).collect()] == ["hello", "", "plain", "", ""]
    bad = "go, " * 60
    got = spark.createDataFrame([(bad,), ("fine words",)], "x string").select(tx.sanitized(F.col("x")).alias("s")).select("s.*").collect()
    assert got[0].text == "" and got[0].reason.startswith("go x 60") and tuple(got[1]) == ("fine words", None)
    reply = '<think>hm</think> {"a": {"b": 1}} done'
    assert spark.range(1).select(tx.outer_object(F.lit(reply))).first()[0] == '{"a": {"b": 1}}'


def test_transcript_documents(spark):
    rows = spark.createDataFrame([("T", "a`b\\c", None, ["One.", "Two."]), (None, None, "m", [])], "title string, source string, model string, parts array<string>")
    made = rows.select(docs.transcript_markdown(F.col("title"), {"Source": F.col("source"), "Model": F.col("model")}, F.col("parts")).alias("d"))
    got = [r.d for r in made.collect()]
    assert got[0] == "# T\n\n## Metadata\n\n- Source: `a\\`b\\\\c`\n\n## Transcript\n\nOne.\n\nTwo.\n\n"
    assert got[1] == "# \n\n## Metadata\n\n- Model: `m`\n\n## Transcript\n\n"
    assert [r[0] for r in made.select(docs.body(F.col("d"))).collect()] == ["One.\n\nTwo.", ""]
    assert spark.range(1).select(docs.body(F.lit("x\n## Segmented Transcript\n\n y \n"))).first()[0] == "y"
    assert spark.range(1).select(docs.body(F.lit(" no heading "))).first()[0] == "no heading"
    assert spark.range(1).select(docs.body_or_error(F.lit("## Transcript\n a"))).first()[0] == "a"
    with pytest.raises(Exception, match="no text after"):
        spark.createDataFrame([("## Transcript\n \n",)], "x string").select(docs.body_or_error(F.col("x"))).collect()


def test_comment_documents(spark, tmp_path):
    reply = '{"rpid": 7, "parent": 3, "ctime": 1700000000, "like": 2, "member": {"uname": "Ann, \\"A\\""}, "content": {"message": "one\\r\\ntwo &amp; more"}}'
    rows = th.comment_rows(spark.createDataFrame([(1, "", reply), (1, "5", "{}"), (1, None, "broken"), (1, "", None)], "aid long, root string, content string"), "root")
    got = rows.orderBy(F.desc("rpid"), F.desc("root_rpid")).collect()
    assert (got[0].root_rpid, got[0].parent_rpid, got[0].rpid, got[0]["like"], got[0].message) == ("7", "3", "7", 2, "one\ntwo & more")
    assert got[0].send_datetime == "2023-11-15 06:13:20"
    assert (got[1].root_rpid, got[1].rpid, got[1].send_date, got[1].ctime, got[1].message) == ("5", "", "", 0, "")
    full = rows.withColumns({c: F.lit("") for c in docs.COMMENT_COLUMNS if c not in rows.columns})
    docs.write_comments_csv(full, str(tmp_path / "c"))
    again = docs.read_comments_csv(spark, str(tmp_path / "c"))
    assert again.columns == list(docs.COMMENT_COLUMNS)
    assert sorted(r.message for r in again.collect()) == ["", "", "", "one\ntwo & more"]
    assert "Ann, \"A\"" in {r.author_name for r in again.collect()}
    heads = spark.createDataFrame([(1, "t", "b", 4), (2, None, None, None)], "aid long, title string, bvid string, comments long")
    flat = rows.withColumn("index", F.lit(1)).withColumn("depth", F.lit(1)).where("rpid = '7'")
    made = {r.aid: r.document for r in docs.comments_markdown(flat, heads, "aid").collect()}
    assert made[1] == "# t\n\n- BVID: `b`\n- AID: `1`\n- Source comments: `4`\n- Exported comments: `1`\n\n    - **Ann, \"A\"** · 2023-11-15 06:13:20 · 2 likes · rpid `7`\n    one\n    two & more\n"
    assert made[2] == "# \n\n- BVID: ``\n- AID: `2`\n- Source comments: ``\n- Exported comments: `0`\n"


def test_caches(spark):
    caches = spark.createDataFrame([(1, ("v", None)), (2, ("v", "x")), (3, ("v", None))], "id long, signature struct<a:string,b:string>")
    wanted = spark.createDataFrame([(1, ("v", None)), (2, ("v", "y")), (3, ("v", None))], "id long, signature struct<a:string,b:string>")
    quality = spark.createDataFrame([(1, 2, "p"), (2, 2, "p"), (3, 1, "p")], "id long, schema_version int, pipeline_version string")
    assert [r.id for r in rp.usable_caches(caches, wanted, quality, "p", ["id"]).collect()] == [1]
    files = spark.createDataFrame([(1, "raw.json"), (1, "final-1.json"), (2, "final-1.json"), (1, None)], "id long, name string")
    left = rp.without_derived(files, files.where("id = 1 and name = 'raw.json'"), ["final-%.json"], ["id"])
    assert {tuple(r) for r in left.collect()} == {(1, "raw.json"), (2, "final-1.json"), (1, None)}
