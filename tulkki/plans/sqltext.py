"""DuckDB SQL text for the oracle side of the registered queries.

These helpers only render SQL strings that restate, in DuckDB's dialect, the
rules the Spark functions implement; they are used by ``oracle_sql()`` and the
tests, never by the Spark jobs.
"""

from __future__ import annotations

from tulkki import dims

PUNCT = r"""'[.,:;!?"''\\\-]'"""
LINE_BREAK = r"'\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'"


def normalize(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower({x}), {PUNCT}, '', 'g'), "
            r"'\s+', ' ', 'g'))")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def split_lines(x: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({x}, {LINE_BREAK}), "
            f"lambda s: {strip('s')}), lambda s: s <> '')")


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def corrupt_line(line: str, doc: str, pos: str, k: str, c: str) -> str:
    h = f"(({doc})*13 + ({pos})*7 + (i-1)*5 + ({k})*3) % 31"
    return (f"array_to_string(flatten(list_transform(string_split({line}, ' '), lambda x, i: "
            f"CASE WHEN {h} >= ({c})*2 + ({k}) THEN [x] WHEN ({h}) % 3 = 0 THEN []::VARCHAR[] "
            f"WHEN ({h}) % 3 = 1 THEN [concat(x, 'q')] ELSE [x, x] END)), ' ')")


def values(rows, cols) -> str:
    return dims.values_sql(rows, cols)


ASR_MODELS = values([(n, f, i + 1) for i, (n, f) in enumerate(dims.ASR_MODELS.items())],
                    ["asr_model", "asr_folder", "model_no"])
MT_MODELS = values([(n, f, i + 1) for i, (n, f) in enumerate(dims.MT_MODELS.items())],
                   ["mt_model", "mt_folder", "model_no"])
CONDITIONS = values(dims.CONDITIONS, ["Condition_Code", "Noise_Level", "Noise_Type", "Voice_Volume"])
OPUS = values([(s, t, m) for (s, t), m in dims.OPUS_MODELS.items()], ["src_lang", "tgt_lang", "opus_model"])
NLLB = values(list(dims.NLLB_CODES.items()), ["lang", "nllb_code"])
GROUPS = "['" + "','".join(dims.SPEAKER_GROUPS) + "']"


def corpus_ctes() -> str:
    """CTEs rec (recordings) and outs (recording x applicable ASR model with lines)."""
    pred = (f"list_filter(list_transform(list_transform(ref_lines, lambda ln, p: "
            f"{corrupt_line('ln', 'doc_id', 'p-1', 'model_no', 'cond_no')}), lambda s: {strip('s')}), "
            f"lambda s: s <> '')")
    return f"""
rec0 AS (
  SELECT doc_id, lang, text, CAST(doc_id % 6 + 1 AS INTEGER) AS cond_no,
         ({GROUPS})[CAST((doc_id // 6) % 4 + 1 AS INTEGER)] AS grp
  FROM documents),
rec AS (
  SELECT *, CASE WHEN doc_id % 10 = 9 THEN 'notes-' || CAST(doc_id AS VARCHAR)
                 WHEN doc_id % 10 = 7 THEN concat_ws('_', upper(lang), grp, 'c' || cond_no, doc_id)
                 ELSE concat_ws('-', lang, replace(grp, '_', '-'), 'c' || cond_no, doc_id) END AS recording
  FROM rec0),
outs0 AS (
  SELECT r.doc_id, r.lang, r.cond_no, r.grp, r.recording, m.asr_model, m.asr_folder, m.model_no,
         {split_lines('r.text')} AS ref_lines
  FROM rec r JOIN {ASR_MODELS} m
    ON (NOT contains(m.asr_model, 'wav2vec2') OR suffix(m.asr_model, r.lang))),
outs AS (
  SELECT *, {pred} AS pred_lines,
         printf('data/results/asr/%s/%s_transcription.txt', asr_folder, recording) AS pred_path
  FROM outs0)"""


#: CTEs a to e over ``pairs`` (pair_id, r, h): word alignment by a recursive dynamic programme; a cell holds
#: 100000 x cost + hits.  e has pair_id, nr, nh, hits, subs, dels, ins.
ALIGN_CTES = """
a AS (SELECT pair_id, r, h, coalesce(list_position(list_transform(range(1, least(len(r), len(h)) + 1), lambda j: r[j] <> h[j]), true) - 1, least(len(r), len(h))) AS pre FROM pairs),
b AS (SELECT pair_id, r AS r0, h AS h0, pre, list_reverse(r[pre + 1:]) AS rr, list_reverse(h[pre + 1:]) AS hr FROM a),
c AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(rr), len(hr)) + 1), lambda j: rr[j] <> hr[j]), true) - 1, least(len(rr), len(hr))) AS suf FROM b),
t AS MATERIALIZED (SELECT pair_id, len(r0) AS nr, len(h0) AS nh, pre + suf AS affix, list_reverse(rr[suf + 1:]) AS r, list_reverse(hr[suf + 1:]) AS h FROM c),
dp(pair_id, i, dv) AS (
  SELECT pair_id, 0, list_transform(range(0, len(h) + 1), lambda j: j * 100000) FROM t
  UNION ALL
  SELECT dp.pair_id, dp.i + 1, CASE WHEN len(t.h) = 0 THEN [(dp.i + 1) * 100000] ELSE
   list_reduce(list_transform(range(1, len(t.h) + 1), lambda j: [j]),
     lambda st, x: list_append(st,
        least(dp.dv[x[1] + 1] // 100000 + 1, st[x[1]] // 100000 + 1, dp.dv[x[1]] // 100000 + (CASE WHEN t.r[dp.i + 1] = t.h[x[1]] THEN 0 ELSE 1 END)) * 100000
        + CASE WHEN least(st[x[1]] // 100000 + 1, dp.dv[x[1]] // 100000 + (CASE WHEN t.r[dp.i + 1] = t.h[x[1]] THEN 0 ELSE 1 END)) >= dp.dv[x[1] + 1] // 100000 + 1 THEN dp.dv[x[1] + 1] % 100000
               WHEN st[x[1]] // 100000 = dp.dv[x[1]] // 100000 - 1 THEN st[x[1]] % 100000
               ELSE dp.dv[x[1]] % 100000 + (CASE WHEN t.r[dp.i + 1] = t.h[x[1]] THEN 1 ELSE 0 END) END),
     [(dp.i + 1) * 100000]) END
  FROM dp JOIN t ON t.pair_id = dp.pair_id WHERE dp.i < len(t.r)),
f AS (SELECT t.pair_id, nr, nh, dv[len(dv)] // 100000 AS cost, dv[len(dv)] % 100000 + affix AS hits FROM dp JOIN t ON t.pair_id = dp.pair_id WHERE dp.i = len(t.r)),
e AS (SELECT pair_id, nr, nh, hits, nr + nh - 2 * hits - cost AS subs, nr - hits - (nr + nh - 2 * hits - cost) AS dels, nh - hits - (nr + nh - 2 * hits - cost) AS ins FROM f)"""
