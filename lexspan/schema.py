"""Row types of the engine."""

from __future__ import annotations

# Words of a clip in list order; times are seconds from its start.
WORD = "clip string, pos bigint, word string, start double, end double"
MATCH = WORD + ", key string, replacement string"
LEXICON = "key string, replacement string, family string"
# JSON contracts.
WORD_LIST = "array<struct<word:string,start:double,end:double>>"
MATCH_LIST = "array<struct<word:string,start:double,end:double,replacement:string>>"
SEGMENTS = "array<struct<words:array<struct<word:string,start:double,end:double>>>>"
MANIFEST = (
    "clip string, status string, words_found array<string>, replacements array<struct<word:string,replacement:string,start:double,end:double>>, "
    "error string, spliced int, skipped_splice int, relative string"
)
STATUSES = ("censored", "clean", "skipped", "error")
TIMELINE = "clip string, seq bigint, kind string, src_start_ms bigint, src_end_ms bigint, match_pos bigint"
BLOCK = "stream_id bigint, block_no bigint, at_us bigint, samples bigint"
AUDIO = "struct<sample_rate:int,channels:int>"
