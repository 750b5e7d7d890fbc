"""String, path and format functions; all are Column expressions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.strip() takes it, for Java and for RE2, and ASCII punctuation.
WHITE = r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
WHITE_RE2 = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PUNCT, PUNCT_RE2 = r"\p{Punct}", "[[:punct:]]"


def _edges(of: str) -> str:
    return rf"^{of}+|{of}+\z"


def strip_white(x: Column) -> Column:
    """Both ends without white space; a null word is the empty one."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), _edges(WHITE), "")


def clean_word(x: Column) -> Column:
    """The matching key: white space off both ends, then ASCII punctuation, then lower case. Inner punctuation stays, and white
    space under punctuation is not stripped again."""
    return F.lower(F.regexp_replace(strip_white(x), _edges(PUNCT), ""))


def family_letter(key: Column) -> Column:
    return F.substring(key, 1, 1)


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, towards zero."""
    return (seconds * 1000).cast("bigint")


def safe_name(text: Column) -> Column:
    """Letters, digits, - and _ stay, others become _; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"), r"^_+|_+\z", "")


def clip_filename(start_ms: Column, end_ms: Column, replacement: Column) -> Column:
    return F.format_string("%08d_%08d_%s.wav", start_ms, end_ms, safe_name(replacement))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last extension with its dot; a name that only starts with a dot has none."""
    return F.regexp_extract(name(path), r"[^/.](\.[^./]+)\z", 1)


def stem(path: Column) -> Column:
    n = name(path)
    return F.substring(n, F.lit(1), F.length(n) - F.length(suffix(path)))


def parent(path: Column) -> Column:
    """What precedes the last slash; the empty string if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)


def relative(path: Column, root: Column) -> Column:
    """The path below root, or the bare name if it is elsewhere."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(name(path))


def mirrored(out: Column, rel: Column) -> Column:
    return F.concat_ws("/", out, rel)


def intermediate(out: Column, rel: Column, what: str) -> Column:
    """Where a file's transcript ('.json'), matches ('_replacements.json') or generated audio ('generated_audio') go."""
    folder = F.concat_ws("/", out, F.lit("_intermediate"), F.when(parent(rel) != "", parent(rel)))
    return F.concat_ws("/", folder, F.lit(what)) if what == "generated_audio" else F.concat(folder, F.lit("/"), stem(rel), F.lit(what))


def path_key(rel: Column) -> Column:
    """Sorts paths by their components."""
    return F.split(rel, "/")


def concat_line(path: Column) -> Column:
    """A line of a concatenation list."""
    return F.concat(F.lit("file '"), F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def key_values(text: Column) -> Column:
    """map of k=v lines, split at the first =; of a key given twice the last holds."""
    pairs = F.filter(F.split(text, r"\r?\n"), lambda x: F.contains(x, F.lit("=")))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_extract(x, r"(?s)^[^=]*=(.*)\z", 1)).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])))


def audio_properties(text: Column) -> Column:
    """struct<sample_rate, channels> of a probe's output; 44100 and 2 where it says nothing usable."""
    kv = key_values(text)
    return F.struct(F.coalesce(kv["sample_rate"].try_cast("int"), F.lit(44100)).alias("sample_rate"), F.coalesce(kv["channels"].try_cast("int"), F.lit(2)).alias("channels"))


def mean_volume(log: Column) -> Column:
    """dB of a volume report, or null."""
    return F.regexp_extract(log, r"mean_volume:\s*(-?\d+\.?\d*)\s*dB", 1).try_cast("double")


def error_text(kind: Column, message: Column, most: int = 200) -> Column:
    return F.left(F.concat(kind, F.lit(": "), message), F.lit(most))


def match_summary(matches: Column) -> Column:
    """word->replacement, comma-joined, of an array of structs."""
    return F.array_join(F.transform(matches, lambda m: F.concat(m["word"], F.lit("->"), m["replacement"])), ", ")


def language(code: Column) -> Column:
    """auto is null, empty is en."""
    return F.when(code == "auto", F.lit(None).cast("string")).when(F.coalesce(code, F.lit("")) == "", F.lit("en")).otherwise(code)


# Video and audio extensions, and (codec, container) by extension; aac, which has none, takes the default.
VIDEO = (".mkv", ".mp4", ".m4v", ".mov", ".avi", ".webm", ".wmv", ".flv")
AUDIO = (".wav", ".mp3", ".m4a", ".m4b", ".flac", ".ogg", ".aac")
MEDIA = VIDEO + AUDIO
CODECS = {
    "m4b": ("aac", "ipod"),
    "m4a": ("aac", "ipod"),
    "mp4": ("aac", "ipod"),
    "mp3": ("libmp3lame", "mp3"),
    "wav": ("pcm_s16le", "wav"),
    "flac": ("flac", "flac"),
    "ogg": ("libvorbis", "ogg"),
}
DEFAULT_CODEC = ("aac", "ipod")


def codec(path: Column) -> Column:
    """struct<codec, container> for an output path."""
    ext = F.lower(F.substring(suffix(path), 2, 100))
    known = F.create_map(*(F.lit(k) if isinstance(k, str) else F.struct(F.lit(k[0]).alias("codec"), F.lit(k[1]).alias("container")) for item in CODECS.items() for k in item))
    return F.coalesce(known[ext], F.struct(F.lit(DEFAULT_CODEC[0]).alias("codec"), F.lit(DEFAULT_CODEC[1]).alias("container")))


def is_media(path: Column, extensions: tuple[str, ...] = MEDIA) -> Column:
    return F.lower(suffix(path)).isin(*extensions)
