"""Golden vectors of the column functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.functions import signal, text

CLEAN = [("Dang,", "dang"), ("'Em", "em"), ("WELL?", "well"), (" hell", "hell"), ("don't", "don't"), ("(damn)!", "damn"), ("half-ass.", "half-ass"), ("--x--", "x"), ("_hell_", "hell"), ("", ""), ("   ", ""), (" hell ", "hell"), ("HELL\n", "hell"), ("hell　", "hell"), ("“damn”", "“damn”"), ("' hell'", " hell"), ("K", "k"), ("\x1chell\x85", "hell"), (None, "")]


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def got(frame, expr):
    return [r["y"] for r in frame.select("i", expr.alias("y")).orderBy("i").collect()]


def test_clean_word(spark):
    assert got(column(spark, [x for x, _ in CLEAN], "string"), text.clean_word(F.col("x"))) == [y for _, y in CLEAN]


def test_clean_word_any_text(spark):
    import string

    seen = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=("Cs",)), st.sampled_from(" \t\n　 '\"-_.")), max_size=12))
    def gather(x):
        seen.append(x)

    gather()
    seen = [x for x in seen if "\x00" not in x and "İ" not in x]
    assert got(column(spark, seen, "string"), text.clean_word(F.col("x"))) == [x.strip().strip(string.punctuation).lower() for x in seen]


def test_milliseconds(spark):
    assert got(column(spark, [2.01, 1.001, 0.29, 2.52, 1.9999, 4.35], "double"), text.to_ms(F.col("x"))) == [2009, 1000, 290, 2520, 1999, 4350]


def test_filenames(spark):
    one = spark.createDataFrame([(1000, 1400, "cool guys"), (123456789, 123456790, "a")], "a bigint, b bigint, r string")
    assert [r[0] for r in one.select(text.clip_filename(F.col("a"), F.col("b"), F.col("r"))).collect()] == ["00001000_00001400_cool_guys.wav", "123456789_123456790_a.wav"]
    assert got(column(spark, ["__a b__", "é-1", "!!"], "string"), text.safe_name(F.col("x"))) == ["a_b", "é-1", ""]


def test_paths(spark):
    paths = column(spark, ["a/b.Tar.MKV", ".mkv", "a/.b", "x", "p/q/r.mp3"], "string")
    assert got(paths, text.suffix(F.col("x"))) == [".MKV", "", "", "", ".mp3"]
    assert got(paths, text.stem(F.col("x"))) == ["b.Tar", ".mkv", ".b", "x", "r"]
    assert got(paths, text.parent(F.col("x"))) == ["a", "", "a", "", "p/q"]
    order = column(spark, ["a.wav", "a-b/x.wav", "a/b.wav", "A/z.wav"], "string")
    assert [r["x"] for r in order.orderBy(text.path_key(F.col("x"))).collect()] == ["A/z.wav", "a/b.wav", "a-b/x.wav", "a.wav"]
    assert got(column(spark, ["/in/a/b.wav", "/other/c.wav"], "string"), text.relative(F.col("x"), F.lit("/in"))) == ["a/b.wav", "c.wav"]
    assert got(column(spark, ["p/q.wav", "q.wav"], "string"), text.intermediate(F.lit("o"), F.col("x"), "_replacements.json")) == ["o/_intermediate/p/q_replacements.json", "o/_intermediate/q_replacements.json"]
    assert got(column(spark, ["it's\\x"], "string"), text.concat_line(F.col("x"))) == ["file 'it\\'s/x'"]


def test_probe_and_log(spark):
    said = column(spark, ["sample_rate=48000\nchannels=1", "sample_rate=N/A", "", "channels=2=3\nchannels=1"], "string")
    assert [tuple(x) for x in got(said, text.audio_properties(F.col("x")))] == [(48000, 1), (44100, 2), (44100, 2), (44100, 1)]
    assert got(column(spark, ["x mean_volume: -20.1 dB y", "mean_volume: -inf dB", None], "string"), text.mean_volume(F.col("x"))) == [-20.1, None, None]
    assert got(column(spark, ["auto", "", None, "de"], "string"), text.language(F.col("x"))) == [None, "en", "en", "de"]


def test_gain(spark):
    rows = spark.createDataFrame([(0, -20.1, -25.6), (1, -10.0, -50.0), (2, -60.0, -20.0), (3, None, -20.0)], "i int, o double, r double")
    assert [round(x, 6) for x in got(rows, signal.gain_db(F.col("o"), F.col("r")))] == [5.5, 24.0, -12.0, 6.0]


@pytest.mark.parametrize(("duration", "target", "chain"), [(2.4, 0.5, [2.0, 1.5]), (2.9, 0.25, [2.0, 2.0, 2.0]), (1.0, 0.4, [0.5]), (1.3, 0.4, []), (1.5, 0.01, [])])
def test_tempo(spark, duration, target, chain):
    found = spark.range(1).select(signal.tempo_chain(F.lit(duration), F.lit(target)).alias("x")).first()["x"]
    assert [round(x, 9) for x in found] == chain


def test_doublings_near_powers(spark):
    values = [v for n in range(1, 31) for v in (2.0**n, math.nextafter(2.0**n, 0), math.nextafter(2.0**n, math.inf), 1.3 * 2.0**n)]

    def loop(v):
        n = 0
        while v > 2.0:
            v, n = v / 2.0, n + 1
        return n

    assert got(column(spark, values, "double"), signal.doublings(F.col("x"))) == [loop(v) for v in values]


def test_fades(spark):
    rows = column(spark, [0.4, 0.05, 0.02], "double")
    assert [tuple(round(v, 6) for v in x) for x in got(rows, signal.fade(F.lit(1.0), F.col("x")))] == [(0.02, 0.38), (0.0125, 0.0375), (0.0, 0.02)]
    assert got(column(spark, [100, 40, 41], "bigint"), signal.gap_fade_at(F.col("x"), F.lit(20))) == [0.08, None, 0.021]


def test_filter_chain(spark):
    said = spark.range(1).select(signal.filter_chain(F.lit(44100), F.lit(1), F.lit(5.5), F.lit(2.4), F.lit(0.5)).alias("x")).first()["x"]
    assert said.startswith("aformat=sample_rates=44100:channel_layouts=mono,silenceremove=")
    assert said.endswith("volume=+5.50dB,atempo=2.0,atempo=1.5000,afade=t=in:st=0:d=0.020000,afade=t=out:st=0.480000:d=0.020000,apad=whole_dur=0.500000")


def test_codecs(spark):
    found = got(column(spark, ["a.MP3", "a.aac", "a", "a.wav"], "string"), text.codec(F.col("x")))
    assert [tuple(x) for x in found] == [("libmp3lame", "mp3"), ("aac", "ipod"), ("aac", "ipod"), ("pcm_s16le", "wav")]
