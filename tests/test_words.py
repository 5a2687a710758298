"""Inputs of all kinds, slot details, marks and times of words, shared sentences."""

from __future__ import annotations

import json
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.functions.slot_table import slot_rows
from tidewater.operators import words as O
from tidewater.plans.registry import ORACLE, QUERIES
from tidewater.sources import inputs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_inputs_of_each_kind(spark, tmp_path, split):
    (tmp_path / "wav.scp").write_text("a1 /x/one two.wav\n\n  a2\t/x/3.wav  \nalone\nÜber ä.wav")
    (tmp_path / "rows.jsonl").write_text(json.dumps({"source": "s1", "key": "k1"}) + "\n" + json.dumps({"source": "s2"}) + "\n")
    (tmp_path / "all.json").write_text(json.dumps([{"key": "j", "source": "s"}, {"source": "t"}, "bare"]))
    (tmp_path / "one.json").write_text(json.dumps({"key": "j1", "source": "s"}))
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "voice.wav").write_bytes(b"RIFF")
    inputs.register(spark)
    got = spark.read.format("utterances").option("paths", str(tmp_path)).option("splitBytes", split).load().collect()
    first = len("a1 /x/one two.wav\n\n  a2\t/x/3.wav  \n".encode())
    second = len(json.dumps({"source": "s1", "key": "k1"})) + 1
    assert sorted((r.key, r.source, r.file.rsplit("/")[-1]) for r in got) == sorted([
        ("a1", "/x/one two.wav", "wav.scp"), ("a2", "/x/3.wav", "wav.scp"), (f"wav-{first}", "alone", "wav.scp"), ("Über", "ä.wav", "wav.scp"), ("k1", "s1", "rows.jsonl"), (f"rows-{second}", "s2", "rows.jsonl"),
        ("j", "s", "all.json"), ("all-1", "t", "all.json"), ("all-2", "bare", "all.json"), ("j1", "s", "one.json"), ("voice", str(tmp_path / "voice.wav"), "voice.wav"),
    ])
    two = spark.read.format("utterances").option("paths", f"{tmp_path}/one.json\n{tmp_path}/rows.jsonl").load()
    assert two.count() == 3
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("utterances").load(str(tmp_path / "nowhere.txt")).count()


def test_inputs_of_a_table_of_many_parts(spark, tmp_path):
    """Each file holds one array, whatever parts the table has: several that a shuffle puts together, empty ones, none."""
    schema = "doc_id long, source string, lang string"
    docs = spark.createDataFrame([(k, None if k == 3 else 'a"b', "en") for k in range(40)], schema)
    tables = {"many": docs.repartition(9, "doc_id"), "gaps": docs.where("doc_id = 3").union(docs.where("doc_id < 0")), "none": docs.where("doc_id < 0")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        for conf in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
            # a file a partition
            spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
            try:
                got = sorted(map(tuple, QUERIES["src_inputs"](spark, f"{tmp_path}/{name}").collect()))
            finally:
                spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
                spark.conf.unset("spark.sql.files.openCostInBytes")
            assert got == sorted(con.execute(ORACLE["src_inputs"]).fetchall())


def test_slot_details():
    rows = {s: (v, d) for s, v, d in slot_rows("saint johns INFORMATION CHARLIE weather at ONE TWO THREE ZERO ZULU WIND TWO FOUR ZERO AT FIVE VISIBILITY ONE FIVE TEMPERATURE MINUS ONE DEW POINT TWO ALTIMETER THREE ZERO TWO THREE RUNWAY TWO EIGHT LEFT FREQUENCY ONE TWO THREE DECIMAL ONE FIVE FLIGHT LEVEL TWO HUNDRED")}
    assert rows == {
        "info_letter": ("PASS", "代号 C"), "obs_time": ("PASS", "1230Z"), "wind": ("PASS", "方向 240° 风速 5kt"), "visibility": ("PASS", "能见度 15(单位未口播)"), "temp_dew": ("FAIL", "温度 -1℃; 露点 2 > 温度 -1 违反物理约束(METAR)"),
        "qnh": ("PASS", "30.23 inHg 合法"), "runway": ("PASS", "跑道 28 LEFT"), "freq": ("PASS", "123.15 MHz 合法"), "flight_level": ("PASS", "FL200 合法"),
    }
    assert slot_rows("good day") == slot_rows(None) == [("free_text", "UNPARSED", "无严格槽位（自由文本行，仅记录）")]
    assert slot_rows("VISIBILITY TWO FOUR THOUSAND") == [("visibility", "PASS", "THOUSAND 候选值 [2400, 24000]（RVR 逐位读法 在域）")]
    assert slot_rows("RUNWAY FOUR ZERO") == [("runway", "FAIL", "跑道号 'FOUR ZERO' 非法(须 01-36)")]
    assert slot_rows("ONE TWO ONE DECIMAL ONE TWO") == [("freq", "WARN", "121.12 MHz 不在 25kHz 网格上")]


def test_slot_details_have_the_verdicts_of_the_expressions(spark):
    rows = QUERIES["num_slot_details"](spark, SF).collect()
    want = sorted(tuple(r) for r in QUERIES["num_all_slots"](spark, SF).select("event_id", "slot", "verdict").collect())
    assert sorted((r.event_id, r.slot, r.verdict) for r in rows) == want and all(r.detail for r in rows)


def test_marks_join_their_neighbours():
    w = lambda *texts: [(t, float(k), k + 0.5) for k, t in enumerate(texts)]
    assert O.attach_marks(w(" He", " said", ",", ' "', "yes", ".", '"', " Now")) == [(" He", 0.0, 0.5), (" said,", 1.0, 1.5), (' "yes."', 4.0, 4.5), (" Now", 7.0, 7.5)]
    assert O.attach_marks(w(" (", " [", "a", ")", "]")) == [(" ( [a)]", 2.0, 2.5)]
    assert O.attach_marks(w(".", " a", " (")) == [(".", 0.0, 0.5), (" a", 1.0, 1.5), (" (", 2.0, 2.5)] and O.attach_marks([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" a", " bc", ",", ".", " (", "(", ")", ' "', '"', "d"]), max_size=12))
def test_attached_words_spell_the_same_text(texts):
    words = [(t, float(k), k + 0.5) for k, t in enumerate(texts)]
    out = O.attach_marks(words)
    assert "".join(t for t, _, _ in out) == "".join(texts)
    assert all((t, a, b) in words or any(a == x for _, x, _ in words) for t, a, b in out)
    # nothing is left that could be attached
    assert not any(x[0] in O.CLOSING and len(x[0]) == 1 for x in out[1:]) or any(o[0].endswith(" ") for o in out)


def test_long_words_are_cut_at_sentence_ends():
    words = [(" a", 0.0, 0.2), (" b", 0.2, 0.4), (".", 0.4, 5.0), (" c", 5.0, 9.0), (" d", 9.0, 12.0), (" e", 12.0, 12.2)]
    want = [(" a", 0.0, 0.2), (" b", 0.2, 0.4), (".", 0.4, 1.8), (" c", 7.6, 9.0), (" d", 9.0, 12.0), (" e", 12.0, 12.2)]
    assert [(t, pytest.approx(a), pytest.approx(b)) for t, a, b in want] == O.shorten(words)
    assert O.shorten([]) == [] and O.shorten([(" a", 1.0, 1.0)]) == [(" a", 1.0, 1.0)]


def test_marks_go_into_the_surface_text():
    assert O.surface_spans(" Über  ALLES x", ["über", "alles", "X"]) == [(1, 5), (7, 12), (13, 14)]
    assert O.surface_spans("a b c", ["a", "b"]) is None and O.surface_spans("", []) == [] and O.surface_spans("ab", ["a", "x"]) is None
    assert O.marked("hello  World now", ["HELLO", "WORLD", "NOW"], [",", "", "."]) == "hello,  World now." and O.marked("a", ["b"], ["."]) is None


def test_sentences_are_shared():
    turns = [(0, 4000, 1), (4000, 9000, 2), (9000, 10000, 1)]
    assert O.share_sentence(0, 10000, "one two three four five", turns) == [(1, 0, 4000, "one two three"), (2, 4000, 10000, "four five")]
    assert O.share_sentence(0, 10000, "x" * 10, turns) == [(1, 0, 4000, "xxxx"), (2, 4000, 10000, "xxxxxx")]
    # a short first part goes to the next, a sentence of one speaker stays whole
    assert O.share_sentence(0, 9000, "a b", [(0, 1000, 1), (1000, 9000, 2)]) == [(2, 0, 9000, "a b")]
    assert O.share_sentence(0, 9000, "a b", []) == [(None, 0, 9000, "a b")] and O.share_sentence(0, 9000, "a b", [(0, 900, 3)]) == [(3, 0, 9000, "a b")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6000), st.integers(0, 2)), min_size=1, max_size=8), st.lists(st.text("ab", min_size=1, max_size=6), min_size=1, max_size=20))
def test_shared_sentences_keep_words_and_time(turns, words):
    at, spans = 0, []
    for n, s in turns:
        spans.append((at, at + n, s))
        at += n
    out = O.share_sentence(0, at, " ".join(words), spans)
    assert " ".join(t for *_, t in out) == " ".join(words)
    assert len(out) == 1 or all(b - a >= 3000 for _, a, b, _ in out)
    assert all(x[2] <= y[1] for x, y in zip(out, out[1:]))


def test_word_queries(spark):
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    merged = defaultdict(list)
    for r in QUERIES["tim_marks_merged"](spark, SF).collect():
        merged[r.conv_id, r.turn].append((r.i, r.word))
    for k, own in merged.items():
        assert "".join("".join(w for _, w in sorted(own)).split()) == "".join(texts[k].split())
    parts = defaultdict(list)
    for r in QUERIES["seg_sentence_parts"](spark, SF).collect():
        parts[r.conv_id, r.turn].append((r.part, r.begin, r.stop, r.text))
    assert set(parts) == set(texts)
    for k, own in parts.items():
        assert " ".join(" ".join(t for *_, t in sorted(own)).split()) == " ".join(texts[k].split())
    labels = QUERIES["sup_segment_speakers"](spark, SF).collect()
    assert labels and all(r.label.startswith("SPK") and r.overlap_ms > 0 for r in labels)


# terms, patterns and tags


def test_patterns_render_lines(spark):
    from pyspark.sql import functions as F

    from tidewater.functions import terms

    lines = {
        "saint johns  INFORMATION FOXTROT WEATHER AT ONE TWO ZERO ZERO ZULU": "圣约翰斯机场通播信息 Foxtrot（F），气象观测时间 1200 世界协调时。",
        "WIND TWO FOUR ZERO AT ZERO FIVE": "风向 240，风速 5 节。",
        "VISIBILITY ONE FIVE TWO FOUR THOUSAND FEET": "能见度 15，云底高 24000 英尺。",
        "VISIBILITY ONE FIVE TWO THOUSAND FEET": "能见度 152。",
        "TEMPERATURE ZERO ONE DEW POINT MINUS ONE": "温度 1℃，露点零下 1℃。",
        "ALTIMETER THREE ZERO TWO THREE": "修正海压 3023（30.23 英寸汞柱）。",
        "ALTIMETER THREE ZERO TWO": "修正海压 302。",
        "APPROACH RNAV ZULU RUNWAY TWO EIGHT": "进近方式 RNAV Z，使用跑道 28。",
        "APPROACH RNAV ZULU RUNWAY FOUR": "进近方式 RNAV Z，使用跑道 4。",
        "INFORM GANDER CENTER ON FREQUENCY ONE TWO THREE DECIMAL ONE FIVE AS REQUESTED": "如需引导可联系冈德中心，频率 123.15。",
        "APPROACH ON INITIAL CONTACT LANDING AND DEPARTING RUNWAY ZERO FIVE": "落地和起飞使用跑道 05，首次联系进近时报告。",
        "INFORM ATC THAT YOU HAVE INFORMATION GOLF": "联系时告知管制（ATC）你已收到通播信息 GOLF。",
        "WIND TWO FOUR ZERO AT FIVE KNOTS": None,
        "": None,
    }
    df = spark.createDataFrame(list(enumerate(lines)), "k long, t string").select("k", terms.rendered(F.col("t")).alias("r"))
    assert [r.r for r in df.orderBy("k").collect()] == list(lines.values())


def test_terms_equal_plain_rules(spark):
    import re

    from pyspark.sql import functions as F

    from tidewater.functions import terms

    rows = [("APPROACH RNAV ZULU RUNWAY TWO", "跑道"), ("approach on WIND", "风"), ("WEATHER AT ONE ZULU", "UTC 天气"), ("RNAV ZULU", ""), ("hello", ""), ("INFORMATION B MINUS AS REQUESTED", "-如需")]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, en string, zh string").select("k", terms.audited(F.col("en"), F.col("zh")).alias("x")).orderBy("k").collect()
    for (en, zh), r in zip(rows, got):
        want = [(p, re.search(p, en.upper())[0], w.split("|")[0], bool(re.search(w, zh))) for p, w in terms.TERMS if re.search(p, en.upper())]
        assert [tuple(x) for x in r.x] == want
    assert len(terms.TERMS) == 22


def test_term_queries_agree(spark):
    audit = QUERIES["num_term_audit"](spark, SF).collect()
    missed = QUERIES["num_term_suggestions"](spark, SF)
    assert sum(r.total - r.hits for r in audit) == missed.count() > 0 and missed.where("current IS NOT NULL").count() > 0
    assert all(r.hit_rate is None or r.hit_rate == round(r.hits / r.total, 9) for r in audit)
    rendered = QUERIES["num_template_rendering"](spark, SF).collect()
    assert {r.event_id % 10 for r in rendered if r.rendered is None} == {9}


def test_rich_text():
    from tidewater.functions import udfs

    cases = {
        "<|en|><|HAPPY|><|BGM|>hello there": "🎼hello there😊",
        "<|en|><|NEUTRAL|><|Speech|>plain": "plain",
        "<|zh|><|HAPPY|><|SAD|>x": "x😊",
        "<|en|><|BGM|><|Laughter|> a <|HAPPY|>": "😀🎼a😊",
        "<|en|><|BGM|><|HAPPY|>a <|zh|><|BGM|><|HAPPY|>b": "🎼ab😊",
        "<|nospeech|><|Event_UNK|>": "❓",
        "<|en|><|Cough|><|odd|>y": "🤧<|odd|>y",
        "": "",
        "no tags": "no tags",
    }
    assert {k: udfs.rich_text(k) for k in cases} == cases and udfs.rich_text(None) is None
