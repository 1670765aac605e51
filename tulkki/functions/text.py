"""Scalar text functions (F1-F19), all built from JVM expressions.

Every function takes and returns a ``Column`` so it stays inside whole-stage
codegen; none of them calls Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tulkki import dims

__all__ = [
    "normalize", "words", "strip", "split_sentences", "sentence_array",
    "parse_recording", "line_index", "recording_base", "audio_name",
    "safe_name", "short_name", "file_name", "file_stem", "stem_before_dot",
    "model_folder", "lang_from_path", "lang_from_name", "result_name",
    "source_status", "model_family", "lower", "truncate_tokens",
    "split_lines",
]

# --- fixed values ----------------------------------------------------------
# punctuation deleted by the metric normalisation: . , : ; ! ? " ' \ -
PUNCT_CLASS = r"""[.,:;!?"'\\\-]"""
# Python's str.isspace set: Unicode White_Space plus U+001C..U+001F
WS = r"[\s\x1c-\x1f]"
# the same, one by one
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# line breaks of Python's str.splitlines
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
# line breaks of text files read with universal newlines
FILE_LINE_BREAK = r"\r\n|\r|\n"
# abbreviations that do not end a sentence (matched case-insensitively)
ABBREVIATIONS = ["M", "Mme", "Mlle", "Mdlle", "Mr", "Mrs", "Dr", "Ms", "etc", "esim", "ks", "jne", "yms"]
# recording name grammar: lang, speaker type, speaker gender, condition
RECORDING_RE = r"^([a-z]{2})[-_]([a-z]{3})[-_]([a-z]{1})[-_](c[1-6])"
LINE_INDEX_RE = r"(?i)[-_]c(\d+)"
TRANSCRIPT_SUFFIX_RE = r"(?i)_transcription\.txt$"
# ---------------------------------------------------------------------------

_PLACEHOLDER = "\ue000"  # private-use code point, never in input text


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lower(col) -> Column:
    """F17."""
    return F.lower(_c(col))


def strip(col) -> Column:
    """F16: remove all edge whitespace (Python ``str.strip``), not only blanks."""
    return F.trim(_c(col), F.lit(WS_CHARS))


def normalize(col) -> Column:
    """lower-case, delete the ten punctuation marks, collapse whitespace."""
    c = F.lower(_c(col))
    c = F.regexp_replace(c, PUNCT_CLASS, "")
    # single blanks, which most are, stay without a replacement
    c = F.regexp_replace(c, rf"(?U){WS}(?:(?<! )|(?={WS})){WS}*", " ")
    return F.trim(c)


def words(col) -> Column:
    """whitespace tokens (Python ``str.split()``), empty text gives []."""
    return F.filter(F.split(_c(col), rf"(?U){WS}+"), lambda w: w != "")


def truncate_tokens(col, n: int) -> Column:
    """keep at most ``n`` whitespace tokens."""
    return F.array_join(F.slice(words(col), 1, n), " ")


def split_lines(col, breaks: str = LINE_BREAK) -> Column:
    """Lines of a text (Python ``splitlines``), stripped, blanks dropped."""
    parts = F.split(_c(col), breaks)
    return F.filter(F.transform(parts, lambda x: strip(x)), lambda x: x != "")


def file_lines(col) -> Column:
    """Lines of a file's text (universal newlines), stripped, blanks dropped."""
    return split_lines(col, FILE_LINE_BREAK)


def sentence_array(col) -> Column:
    """F2 as an array of sentences."""
    abbr = "|".join(ABBREVIATIONS)
    t = F.coalesce(strip(col), F.lit(""))
    t = F.regexp_replace(t, rf"(?iU)\b({abbr})\.{WS}*", "$1" + _PLACEHOLDER)
    t = F.regexp_replace(t, rf"(?U)\.{WS}*", ".\n")
    t = F.replace(t, F.lit(_PLACEHOLDER), F.lit(". "))
    return split_lines(t)


def split_sentences(col) -> Column:
    """one sentence per line; ``!``/``?`` do not split, abbreviations do not."""
    return F.array_join(sentence_array(col), "\n")


def parse_recording(col) -> Column:
    """struct(lang, speaker_type, speaker_gender, condition, speaker_group).

    No match gives NULL fields; the row is kept.
    """
    c = _c(col)
    ok = c.rlike(RECORDING_RE)
    g = [F.when(ok, F.regexp_extract(c, RECORDING_RE, i)) for i in (1, 2, 3, 4)]
    return F.struct(
        g[0].alias("lang"), g[1].alias("speaker_type"), g[2].alias("speaker_gender"),
        g[3].alias("condition"),
        F.when(ok, F.concat_ws("_", g[1], g[2])).alias("speaker_group"),
    )


def line_index(col) -> Column:
    """number after the first ``[-_]c`` minus one; -1 when absent."""
    c = _c(col)
    num = F.when(c.rlike(LINE_INDEX_RE), F.regexp_extract(c, LINE_INDEX_RE, 1))
    return F.coalesce(num.try_cast("bigint") - 1, F.lit(-1).cast("bigint"))


def recording_base(col) -> Column:
    """drop ``_transcription.txt`` (any case), else drop the extension."""
    c = _c(col)
    return F.when(c.rlike(TRANSCRIPT_SUFFIX_RE), F.regexp_replace(c, TRANSCRIPT_SUFFIX_RE, "")) \
            .otherwise(file_stem(c))


def file_name(col) -> Column:
    """Last path component."""
    return F.substring_index(_c(col), "/", -1)


def file_stem(col) -> Column:
    """Name without its extension (``os.path.splitext`` rules: leading dots are no extension)."""
    return F.regexp_replace(file_name(col), r"^(.*[^.].*)\.[^.]*$", "$1")


def stem_before_dot(col) -> Column:
    """Name cut at its first dot."""
    return F.substring_index(file_name(col), ".", 1)


def audio_name(base, parsed) -> Column:
    """canonical ``lang-type-gender-cond.wav`` when parsed, else ``base.wav``."""
    p = _c(parsed)
    canon = F.concat_ws("-", p["lang"], p["speaker_type"], p["speaker_gender"], p["condition"])
    return F.concat(F.when(p["lang"].isNotNull(), canon).otherwise(_c(base)), F.lit(".wav"))


def safe_name(col) -> Column:
    """``/``, ``-`` and ``.`` become ``_``."""
    return F.translate(_c(col), "/-.", "___")


def short_name(col) -> Column:
    """F8: text after the last ``/``."""
    return F.substring_index(_c(col), "/", -1)


def model_folder(col) -> Column:
    """parent folder of a path; ``unknown_model`` when there is none."""
    parts = F.split(_c(col), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit("unknown_model"))


def lang_from_path(col, langs=None) -> Column:
    """the path part after ``data`` when it is a known language."""
    langs = langs or dims.LANGUAGES
    parts = F.split(_c(col), "/")
    at = F.array_position(parts, "data")
    nxt = F.when((at > 0) & (F.size(parts) > at), F.element_at(parts, (at + 1).cast("int")))
    return F.when(nxt.isin(*langs), nxt)


def lang_from_name(col, langs=None) -> Column:
    """first two letters of the file name, lower-cased, when known."""
    langs = langs or dims.LANGUAGES
    code = F.lower(F.substring(file_name(col), 1, 2))
    return F.when(code.isin(*langs), code)


def result_name(kind: str, **parts) -> Column:
    """output file names of each stage."""
    p = {k: _c(v) for k, v in parts.items()}
    if kind == "mt_prediction":
        return F.format_string("%s_%s_%s2%s_results.txt", p["base"], p["model"], p["src"], p["tgt"])
    if kind == "asr_transcript":
        return F.format_string("%s_%s_transcription.txt", p["base"], p["model"])
    if kind == "asr_eval":
        return F.format_string("asr_eval_%s_%s.json", p["lang"], p["model"])
    if kind == "mt_eval":
        return F.format_string("mt_evaluation_%s_%s2%s.json", p["model"], p["src"], p["tgt"])
    raise ValueError(kind)


def source_status(col, task=None) -> Column:
    """``N/A (ASR Task)`` for ASR rows, ``Human Source`` or ``ASR Source (<lang>_<model>)``."""
    c = _c(col)
    label = F.concat(F.lit("ASR Source ("),
                     F.replace(F.replace(file_name(c), F.lit("asr_eval_"), F.lit("")),
                               F.lit(".json"), F.lit("")),
                     F.lit(")"))
    out = F.when(c.isNull() | (F.upper(c) == "HUMAN SOURCE") | (c == ""), F.lit(dims.HUMAN_SOURCE)).otherwise(label)
    if task is not None:
        out = F.when(_c(task) == "ASR", F.lit(dims.ASR_TASK_STATUS)).otherwise(out)
    return out


def model_family(col) -> Column:
    """text before the first ``_``."""
    return F.substring_index(_c(col), "_", 1)
