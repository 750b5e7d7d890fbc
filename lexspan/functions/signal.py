"""Loudness, tempo, fade and block parameters, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FADE_MS = 20
DEFAULT_GAIN, LEAST_GAIN, MOST_GAIN = 6.0, -12.0, 24.0
LEAD_IN_MS = {"a": 50, "s": 50}
PADDING_S, LEAST_SPEECH_S, LEAST_MEASURED_S = 0.9, 0.1, 0.02
FASTER, SLOWER, SLOWEST, STEP = 1.05, 0.95, 0.5, 2.0
RATE, BLOCK, LEAST_MUTE_S, BEEP_HZ, BEEP_LEVEL, DELAY_S = 16000, 1024, 0.15, 1000.0, 0.3, 2.0
TRIM = "silenceremove=start_periods=1:start_silence=0.01:start_threshold=-45dB:detection=peak"


def lead_in_ms(key: Column, override: int | None = None) -> Column:
    """Milliseconds of silence before a word: by its first letter, or the same for all."""
    if override is not None:
        return F.lit(override).cast("bigint")
    out = F.lit(0)
    for letter, ms in LEAD_IN_MS.items():
        out = F.when(F.substring(key, 1, 1) == letter, F.lit(ms)).otherwise(out)
    return out.cast("bigint")


def measurable(duration_s: Column, db: Column) -> Column:
    """db where the range is long enough to measure, else null."""
    return F.when(duration_s > LEAST_MEASURED_S, db)


def gain_db(original: Column, replacement: Column) -> Column:
    return F.greatest(F.lit(LEAST_GAIN), F.least(F.lit(MOST_GAIN), F.coalesce(original - replacement, F.lit(DEFAULT_GAIN))))


def volume_written(gain: Column) -> Column:
    return F.abs(gain) > 0.01


def speed(duration_s: Column, target_s: Column) -> Column:
    """How much faster the speech must be; null where no tempo applies at all."""
    fits = (target_s > LEAST_MEASURED_S) & (duration_s > LEAST_MEASURED_S)
    return F.when(fits, F.greatest(F.lit(LEAST_SPEECH_S), duration_s - PADDING_S) / target_s)


def doublings(v: Column) -> Column:
    """How many powers of two from the first on are below v. The logarithm may be off by one, so it is corrected by exact powers."""
    n = F.greatest(F.floor(F.log2(F.greatest(v, F.lit(1.0)))).cast("int"), F.lit(0))
    return (n + F.when(v > F.pow(F.lit(STEP), n + 1), 1).otherwise(0) - F.when((n > 0) & (v <= F.pow(F.lit(STEP), n)), 1).otherwise(0)).cast("int")


def tempo(duration_s: Column, target_s: Column) -> Column:
    """struct<n, rest>: n halvings by 2.0 and then the rest; null rest: no tempo filter."""
    v = speed(duration_s, target_s)
    fast = v > FASTER
    n = F.when(fast, doublings(v)).otherwise(0)
    return F.struct(n.cast("int").alias("n"), F.when(fast, v / F.pow(F.lit(STEP), n)).when(v < SLOWER, F.greatest(F.lit(SLOWEST), v)).alias("rest"))


def tempo_chain(duration_s: Column, target_s: Column) -> Column:
    t = tempo(duration_s, target_s)
    return F.array_compact(F.concat(F.array_repeat(F.lit(STEP), t["n"]), F.array(t["rest"])))


def fade(duration_s: Column, target_s: Column, fade_ms: int = FADE_MS) -> Column:
    """struct<length, out_at>: the fade's length at either end, and where the closing one starts."""
    whole = F.when(F.coalesce(target_s, F.lit(0.0)) != 0, target_s).otherwise(duration_s)
    length = F.when(whole > LEAST_MEASURED_S, F.least(F.lit(fade_ms / 1000), whole / 4)).otherwise(F.lit(0.0))
    return F.struct(length.alias("length"), F.greatest(F.lit(0.0), whole - length).alias("out_at"))


def gap_fade_at(duration_ms: Column, fade_ms: Column) -> Column:
    """Where a gap's closing fade starts, in seconds; null: none."""
    return F.when((fade_ms > 0) & (duration_ms > 2 * fade_ms), F.greatest(F.lit(0.0), (duration_ms - fade_ms) / 1000))


def layout(channels: Column) -> Column:
    return F.when(channels == 2, "stereo").otherwise("mono")


def _fixed(form: str, places: int, *values: Column) -> Column:
    """Numbers with so many places, ties to even as the filters' own reader prints them (the formatter alone rounds ties up)."""
    return F.format_string(form, *(F.bround(v, places) for v in values))


def filter_chain(rate: Column, channels: Column, gain: Column, duration_s: Column, target_s: Column, fade_ms: int = FADE_MS) -> Column:
    """The replacement's filters in order, comma-joined."""
    t, f = tempo(duration_s, target_s), fade(duration_s, target_s, fade_ms)
    whole = F.when(F.coalesce(target_s, F.lit(0.0)) > 0, _fixed("apad=whole_dur=%.6f", 6, target_s))
    parts = F.concat(
        F.array(F.format_string("aformat=sample_rates=%d:channel_layouts=%s", rate, layout(channels)), F.lit(TRIM), F.lit("areverse"), F.lit(TRIM), F.lit("areverse"), F.when(volume_written(gain), _fixed("volume=%+.2fdB", 2, gain))),
        F.array_repeat(F.lit("atempo=2.0"), t["n"]),
        F.array(F.when(t["rest"].isNotNull(), _fixed("atempo=%.4f", 4, t["rest"])), F.when(f["length"] > 0, _fixed("afade=t=in:st=0:d=%.6f", 6, f["length"])), F.when(f["length"] > 0, _fixed("afade=t=out:st=%.6f:d=%.6f", 6, f["out_at"], f["length"])), whole),
    )
    return F.array_join(F.array_compact(parts), ",")


def power_of(samples: Column) -> Column:
    """Sum of squares of a block of normalised samples."""
    return F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x * x)


def mean_volume_of(power: Column, n: Column) -> Column:
    """dBFS of n samples whose squares add up to power; null for none and for silence."""
    return F.when((n > 0) & (power > 0), 10 * F.log10(power / n))


def tone_at(i: Column) -> Column:
    """The i-th sample of a block of the tone."""
    return BEEP_LEVEL * F.sin(2 * 3.141592653589793 * BEEP_HZ * i / RATE)


def beep(n: int = BLOCK) -> Column:
    """A block of a 1 kHz tone; its phase starts anew in each block."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), tone_at)


def spoken_duration(seconds: Column) -> Column:
    """h:mm:ss, m:ss or seconds, for reports."""
    s = seconds.cast("bigint")
    return F.when(s >= 3600, F.format_string("%dh %02dm %02ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%.1fs", seconds))


def megabytes(size: Column) -> Column:
    return F.round(size / (1024 * 1024), 1)
