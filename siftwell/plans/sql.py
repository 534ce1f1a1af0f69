"""Small builders for the SQL side: the same arithmetic as in functions/, written for DuckDB."""

from __future__ import annotations

from .. import lexicons as L
from ..sources.tables import PER_PAPER, SECTIONS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def kw(text: str, word: str) -> str:
    return f"((length({text}) - length(replace({text}, {q(word)}, ''))) // {len(word)})"


def kwsum(text: str, words) -> str:
    return "(" + " + ".join(["0", *(kw(text, w) for w in words)]) + ")"


def present(text: str, words) -> str:
    return "(" + " + ".join(["0", *(f"contains({text}, {q(w)})::INT" for w in words)]) + ")"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(["FALSE", *(f"contains({text}, {q(w)})" for w in words)]) + ")"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def words(text: str) -> str:
    return count(text, r"[\p{L}\p{N}_]+")


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: NOT list_contains({arr(L.STOPWORDS)}, t))"


def letters(text: str) -> str:
    return f"length(regexp_replace({text}, '[^\\p{{L}}]', '', 'g'))"


def digits(text: str) -> str:
    return f"length(regexp_replace({text}, '[^0-9]', '', 'g'))"


def lines(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '\\r\\n|\\n|\\r'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def case(key: str, values: dict, default: str) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {key} = {q(k)} THEN {lit(v)}" for k, v in values.items()) + f" ELSE {default} END" if values else default


SECTION = f"({arr(SECTIONS)})[label + 1]"
CHUNKS = f"""chunks AS (
  SELECT e.vec_id AS chunk_id, (e.vec_id // {PER_PAPER})::BIGINT AS paper_id, (e.vec_id % {PER_PAPER})::INTEGER AS chunk_index, {SECTION} AS section_name,
         CASE WHEN e.vec_id % 3 > 0 THEN 'part ' || (e.vec_id % 3)::VARCHAR END AS subsection_name, e.embedding::DOUBLE[] AS v
  FROM embeddings e)"""
TEXTS = f"{CHUNKS}, texts AS (SELECT c.*, d.text AS content FROM chunks c JOIN documents d ON d.doc_id = c.chunk_id)"


def score(vec_id: int) -> str:
    return f"round(list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec_id})), 6)"


def technical(text: str) -> str:
    # RE2 has no look-around: runs of word characters are taken first, then tested as wholes.
    runs = f"len(list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{7,}}')))"
    symbols = count(text, r"[=<>+\-*/^]|O\(|\\[a-zA-Z]+")
    return f"CASE WHEN {words(text)} = 0 THEN 0.0 ELSE least(1.0, ({runs} + 2 * {symbols}) / {words(text)}::DOUBLE) END"


def citations(text: str) -> str:
    return "((" + " + ".join(count(f"lower({text})", p) for p in L.CITATIONS) + f") / greatest(1, {words(text)})::DOUBLE)"


def table_density(text: str) -> str:
    upper = f"length(regexp_replace(s, '[^\\p{{Lu}}]', '', 'g')) / greatest(1, {letters('s')})::DOUBLE"
    noisy = f"contains(s, '|') OR contains(s, chr(9)) OR {digits('s')} / greatest(1, length(s))::DOUBLE > 0.35 OR ({upper} > 0.85 AND length(s) < 40)"
    return f"CASE WHEN len({lines(text)}) = 0 THEN 0.0 ELSE len(list_filter({lines(text)}, lambda s: {noisy})) / len({lines(text)})::DOUBLE END"


def quality(text: str) -> str:
    n, low, size = "n_words", f"lower({text})", f"greatest(1, length({text}))::DOUBLE"
    return f"""round(CASE WHEN {n} = 0 THEN -2.0::DOUBLE ELSE
      CASE WHEN {n} >= 80 THEN 1.0::DOUBLE WHEN {n} >= 40 THEN 0.6 WHEN {n} >= 20 THEN 0.2 ELSE -0.4 END
      - CASE WHEN {letters(text)} / {size} < 0.45 THEN 0.6::DOUBLE ELSE 0 END
      - CASE WHEN cite > 0.03 THEN 1.35::DOUBLE WHEN cite > 0.015 THEN 0.7 ELSE 0 END
      - CASE WHEN rows > 0.6 THEN 1.0::DOUBLE WHEN rows > 0.35 THEN 0.7 ELSE 0 END
      - CASE WHEN {digits(text)} / {size} > 0.18 AND {kw(text, chr(10))} / greatest(1, {n})::DOUBLE > 0.12 THEN 0.8::DOUBLE ELSE 0 END
      - CASE WHEN length({squeeze(text)}) < 20 THEN 1.0::DOUBLE WHEN {words(squeeze(text))} <= 4 THEN 0.8 ELSE 0 END
      - CASE WHEN starts_with({low}, 'table ') OR starts_with({low}, 'figure ') OR starts_with({low}, 'equation:') THEN 0.8::DOUBLE ELSE 0 END
      + CASE WHEN {any_of(low, ["we propose", "our proposed", "in this work"])} THEN 0.3::DOUBLE ELSE 0 END END, 4)"""


def signals(text: str) -> dict[str, str]:
    low = f"lower({text})"
    return {
        "equation": f"(regexp_matches({low}, '\\b(theorem|lemma|proof|corollary|equation)\\b') OR {kw(text, '=')} >= 2 OR contains({text}, 'O('))",
        "pseudo": f"({present(low, L.PSEUDOCODE)} >= 2)",
        "result": f"({present(low, L.RESULT_CUES)} >= 2)",
        "metric": f"({any_of(low, L.METRICS)} OR regexp_matches({text}, '\\b[0-9]+(\\.[0-9]+)?\\s*%') OR (regexp_matches({text}, '\\b[0-9]+(\\.[0-9]+)?\\b') AND {any_of(low, ['table', 'figure'])}))",
    }


def roles(text: str, section: str, keywords: dict[str, list[str]]) -> str:
    """Columns s_<role> from hints, words and signals; ``at`` is the effective section."""
    sig = signals(text)
    bonus = {"equation": [("equation", 0.75)], "formula": [("equation", 0.55)], "theory": [("equation", 0.35)], "algorithm": [("equation", 0.12), ("pseudo", 0.35)], "implementation": [("pseudo", 0.15)], "evaluation": [("result", 0.35), ("metric", 0.45)], "discussion": [("result", 0.1)]}
    hint = case(section, L.SECTION_ROLE_HINTS, "NULL")
    out = []
    for r, w in keywords.items():
        more = "".join(f" + CASE WHEN {sig[s]} THEN {b}::DOUBLE ELSE 0 END" for s, b in bonus.get(r, []))
        out.append(f"round(CASE WHEN ({hint}) = {q(r)} THEN 1.0::DOUBLE ELSE 0 END + {kwsum(f'lower({text})', w)} * 0.18::DOUBLE{more}, 6) AS s_{r}")
    return ", ".join(out)


def first_best(scores: list[tuple[str, str]]) -> str:
    top = "greatest(" + ", ".join(s for _, s in scores) + ")"
    return "CASE " + " ".join(f"WHEN {s} = {top} THEN {q(n)}" for n, s in scores) + " END"


def follow_up(query: str) -> str:
    low = squeeze(f"lower({query})")
    tests = " OR ".join(f"regexp_matches({low}, {q(p)})" for p in L.FOLLOW_UP_PATTERNS)
    return f"({low} <> '' AND (list_contains({arr(L.FOLLOW_UP_STARTERS)}, split_part({low}, ' ', 1)) OR (len(string_split({low}, ' ')) <= 7 AND list_has_any(string_split({low}, ' '), {arr(['it', 'that', 'this', 'they', 'them'])})) OR {tests}))"


def truncate(text: str, most: int) -> str:
    s = squeeze(text)
    return f"CASE WHEN length({s}) <= {most} THEN {s} ELSE rtrim(substr({s}, 1, {most - 3})) || '...' END"


def lower_first(text: str, words) -> str:
    return "(" + " OR ".join(f"starts_with(lower(trim({text})), {q(w)})" for w in words) + ")"


def fragments(text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q('(?i)' + p)})" for p in L.BANNED_FRAGMENTS) + ")"


def heavy(text: str) -> str:
    markers = count(f"lower({text})", r"\[equation\]|=|o\(|\\[a-z]+|\bfrac\b")
    brackets = f"length(regexp_replace({text}, '[^()\\[\\]{{}}]', '', 'g'))"
    return f"(regexp_full_match({text}, {q(SYMBOLS_ONLY)}) OR {fragments(text)} OR ({markers} >= 3 AND {letters(text)} < 50) OR ({brackets} >= 12 AND {letters(text)} < 80))"


SYMBOLS_ONLY = r"[0-9\s+\-*/^=<>()\[\]{}|.,:;%]+"


def metric_line(line: str) -> str:
    low = f"lower({line})"
    named = f"(regexp_matches({low}, '\\b(test|dev|baseline|ablation|ours|proposed)\\b') AND regexp_matches({line}, '\\b[0-9]+(\\.[0-9]+)?\\b'))"
    return f"({any_of(low, L.METRICS)} OR regexp_matches({line}, '\\b[0-9]+(\\.[0-9]+)?\\s*%') OR {named})"


def cleaned(source: str, text: str) -> str:
    """CTEs from a relation to ``cleaned``: it with ``clean`` and ``summary``. RE2 has no look-around: sentence ends are marked first."""
    mark = r"regexp_replace({0}, '([.!?])\s+([A-Z0-9\[])', '\1' || chr(1) || '\2', 'g')"
    return f"""c_raw AS (SELECT *, {squeeze(f"replace({text}, chr(0), ' ')")} AS c_raw, {lines(text)} AS c_lines FROM {source}),
c_marked AS (SELECT *, {squeeze("regexp_replace(c_raw, '(?i)' || chr(92) || 'bEQUATION:' || chr(92) || 's*', '[equation] ', 'g')")} AS c_m FROM c_raw),
c_adv AS (SELECT *, CASE WHEN regexp_matches(c_m, '^[A-Z0-9\\[]') THEN c_m WHEN instr({mark.format('c_m')}, chr(1)) > 0 THEN ltrim(substr({mark.format('c_m').replace(", 'g')", ")")}, instr({mark.format('c_m').replace(", 'g')", ")")}, chr(1)) + 1)) END AS c_a FROM c_marked),
c_clean AS (SELECT *, CASE WHEN starts_with(lower(c_raw), 'table:') THEN CASE WHEN len(list_filter(c_lines[2:], lambda s: {metric_line('s')})) > 0 THEN {squeeze(f"array_to_string(list_concat(c_lines[1:1], (list_filter(c_lines[2:], lambda s: {metric_line('s')}))[1:4]), chr(10))")} END
  WHEN c_raw <> '' AND NOT {lower_first('c_raw', L.BANNED_STARTS)} AND NOT {heavy('c_m')} AND NOT {lower_first('c_a', L.BANNED_STARTS)} AND NOT {heavy('c_a')} THEN c_a END AS clean FROM c_adv),
c_parts AS (SELECT *, (list_filter(list_transform(string_split({mark.format('clean')}, chr(1)), lambda s: trim(s)), lambda s: s <> ''))[1:152] AS c_p FROM c_clean),
c_sizes AS (SELECT *, list_transform(range(1, len(c_p) + 1), lambda i: length(array_to_string(c_p[1:i], ' '))) AS c_n FROM c_parts),
c_taken AS (SELECT *, least(len(list_filter(c_n, lambda n: n <= 300)), len(list_filter(c_n, lambda n: n < 140)) + 1, len(c_p)) AS c_t FROM c_sizes),
c_packed AS (SELECT *, array_to_string(c_p[1:greatest(c_t, 1)], ' ') AS c_s FROM c_taken),
c_cut AS (SELECT *, CASE WHEN length(c_s) > 297 THEN trim(regexp_replace(substr(c_s, 1, 297), ' [^ ]*$', '')) ELSE c_s END AS c_e FROM c_packed),
cleaned AS (SELECT * EXCLUDE (c_raw, c_lines, c_m, c_a, c_p, c_n, c_t, c_s, c_e), CASE WHEN len(c_p) > 0 THEN substr(CASE WHEN c_t < len(c_p) THEN CASE WHEN ends_with(c_e, '...') THEN c_e ELSE c_e || '...' END ELSE c_s END, 1, 300) END AS summary FROM c_cut)"""


def quality_chunk(summary: str, role: str, confidence: str) -> str:
    s = f"trim(coalesce({summary}, ''))"
    # RE2's word boundary is of ASCII: other letters are made word characters first.
    low, n = f"lower({s})", count(f"regexp_replace({s}, '[À-ÖØ-öø-ɏͰ-῿Ⰰ-퟿]', '_', 'g')", r"\b[A-Za-z][A-Za-z\-]*\b")
    metric = signals(s)["metric"]
    short = f"""({words(s)} > 0 AND {words(s)} <= 40 AND (({role} IN ('equation', 'formula', 'theory') AND (contains({s}, '=') OR contains({low}, '[equation]'))) OR ({role} = 'evaluation' AND {metric})
  OR ({role} IN ('method', 'algorithm') AND {any_of(low, ['objective', 'loss', 'defined as', 'denotes', 'represents'])})))"""
    phrase = f"({n} <= 1 OR ({n} <= 5 AND NOT regexp_matches({s}, {q('(?i)' + chr(92) + 'b(' + '|'.join(L.VERBS) + ')' + chr(92) + 'b')})))"
    good = f"({role} <> 'other' AND length({s}) >= 40 AND regexp_matches({s}, '^[A-Z0-9\\[]') AND NOT {lower_first(s, L.BANNED_STARTS)} AND NOT regexp_full_match({s}, {q(SYMBOLS_ONLY)}) AND NOT {fragments(s)} AND {letters(s)} >= 20 AND NOT {phrase})"
    return f"({confidence} >= 0.35 AND ({short} OR {good}))"


def formula_bonus(role: str, text: str) -> str:
    low = f"lower({text})"
    signal = f"({any_of(low, ['equation', 'formula', 'objective', 'defined as', 'denotes'])} OR regexp_matches({text}, '=|\\\\[a-zA-Z]+|O\\(|argmax|argmin'))"
    return f"""least(1.0::DOUBLE, CASE WHEN {role} IN ('equation', 'formula') THEN 1.0::DOUBLE WHEN {role} = 'theory' THEN 0.8 WHEN {role} IN ('method', 'algorithm') THEN 0.35 ELSE 0.0 END + CASE WHEN {signal} THEN 0.45::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches({low}, '\\b(w0|ba|ax|h)\\b') THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN {any_of(text, ['Δ', '∆', '∈', '×'])} THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN {any_of(low, ['defined as', 'denotes', 'represents', 'objective', 'loss'])} THEN 0.25::DOUBLE ELSE 0 END)"""
