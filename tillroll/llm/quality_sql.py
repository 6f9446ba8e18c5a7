"""SQL twin of the quality rules: the same estimates, step by step, for the row comparison."""

from __future__ import annotations

from tillroll.llm.quality import (
    FLOORS,
    HALF,
    SYMBOLS,
    TAIL,
    P,
    _consistency,
    chi2_quantile,
)

#: concentration steps written out; the operator's groups stand still after fewer
STEPS = 8

_GROUP = "lang IS NOT DISTINCT FROM {0}.lang AND source IS NOT DISTINCT FROM {0}.source"


def _bin(value: str) -> str:
    return f"floor(200 * ln(least(greatest({value}, 1e-9), 1e8)))"


def _border(name: str, rows: str, value: str, share: float) -> str:
    """(lang, source, top): least bin up to which ``share`` of a group's rows lie."""
    return f"""{name} AS (SELECT lang, source, min(bin) AS top FROM (
      SELECT lang, source, bin, sum(n) OVER (PARTITION BY lang, source ORDER BY bin) AS up,
             sum(n) OVER (PARTITION BY lang, source) AS every
      FROM (SELECT lang, source, {value} AS bin, count(*) AS n FROM {rows} GROUP BY ALL))
      WHERE up >= every * {share!r} GROUP BY lang, source)"""


def _estimate(name: str, rows: str, scale: float) -> list[str]:
    sums = ["count(*) AS n"] + [f"avg(x{i}) AS m{i}" for i in range(P)]
    sums += [f"avg(x{i} * x{j}) AS q{i}{j}" for i in range(P) for j in range(i + 1)]
    parts = [f"{name}_s AS (SELECT lang, source, {', '.join(sums)} FROM {rows} GROUP BY lang, source)"]
    before = f"{name}_s"
    for i in range(P):
        for j in range(i + 1):
            value = f"(q{i}{j} - m{i} * m{j}) * {scale!r}"
            if i == j:
                value = f"greatest({value}, 0.0) + {FLOORS[i] ** 2!r}"
            for k in range(j):
                value += f" - l{i}{k} * l{j}{k}"
            least = FLOORS[i] ** 2 / 4
            value = f"sqrt(greatest({value}, {least!r}))" if i == j else f"({value}) / l{j}{j}"
            after = name if (i, j) == (P - 1, P - 1) else f"{name}_{i}{j}"
            parts.append(f"{after} AS (SELECT *, {value} AS l{i}{j} FROM {before})")
            before = after
    return parts


def _distance(name: str, rows: str, estimate: str, join: str = "") -> list[str]:
    steps, before = [], f"(SELECT r.*, e.* EXCLUDE (lang, source) FROM {rows} r {join} JOIN {estimate} e ON r." \
        + _GROUP.format("e").replace(" AND ", " AND r.") + ")"
    for i in range(P):
        value = f"x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i))
        before = f"(SELECT *, ({value}) / l{i}{i} AS z{i} FROM {before})"
    d2 = " + ".join(f"z{i} * z{i}" for i in range(P))
    steps.append(f"{name} AS MATERIALIZED (SELECT *, {d2} AS d2 FROM {before})")
    return steps


def oracle() -> str:
    """All of it as one statement."""
    space = r"[\x20\x09-\x0D]"
    symbols = f"length(regexp_replace(body, '[^{SYMBOLS}]', '', 'g'))".replace("[^#*$%&|<>]", r"[^#*$%&|<>]")
    parts = [
        f"""words AS (SELECT doc_id, lang, source, coalesce(text, '') AS body,
          list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda w: w <> '') AS w,
          list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '{space}', '', 'g') <> '') AS s
          FROM documents)""",
        """windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM (
          SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)))""",
        """repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM (
          SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE times > 1) GROUP BY doc_id)""",
        f"""counted AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words,
          length(regexp_replace(body, '{space}', '', 'g'))::BIGINT AS word_chars,
          {symbols}::BIGINT AS n_symbols,
          (len(s) - len(list_distinct(s)))::BIGINT AS n_dup_lines,
          coalesce(r.n, 0)::BIGINT AS n_repeat_words
          FROM words w LEFT JOIN repeats r ON w.doc_id = r.doc_id)""",
        """judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
          ln(greatest(word_chars, 1) / greatest(n_words, 1)) AS x0,
          ln(1 + 100 * n_symbols / greatest(n_words, 1)) AS x1,
          ln(1 + 100 * n_dup_lines / greatest(n_words, 1)) AS x2,
          ln(1 + 100 * n_repeat_words / greatest(n_words, 1)) AS x3 FROM counted)""",
        "vectors AS MATERIALIZED (SELECT lang, source, x0, x1, x2, x3 FROM judged WHERE NOT base_failed)",
    ]
    join = "".join(
        f" JOIN c{i} ON v.{_GROUP.format(f'c{i}').replace(' AND ', ' AND v.')}" for i in range(P)
    )
    for i in range(P):
        parts.append(_border(f"c{i}", "vectors", f"floor(x{i} * 1000)", 0.5))
    parts.append(
        "centred AS (SELECT v.*, " + ", ".join(f"c{i}.top AS t{i}" for i in range(P)) + f" FROM vectors v{join})"
    )
    for i in range(P):
        parts.append(_border(f"s{i}", "centred", f"abs(floor(x{i} * 1000) - t{i})", 0.5))
    join = "".join(
        f" JOIN s{i} ON v.{_GROUP.format(f's{i}').replace(' AND ', ' AND v.')}" for i in range(P)
    )
    far = " + ".join(
        f"pow((x{i} - t{i} / 1000) / greatest(s{i}.top * 0.0014826, {FLOORS[i]!r}), 2)" for i in range(P)
    )
    parts.append(f"d0 AS (SELECT v.lang, v.source, x0, x1, x2, x3, 0.0 + {far} AS d2 FROM centred v{join})")
    share, scale = HALF, _consistency(HALF)
    for k in range(STEPS + 1):
        parts.append(_border(f"b{k}", f"d{k}", _bin("d2"), share))
        near = _GROUP.format("b").replace(" AND ", " AND d.")
        parts.append(
            f"n{k} AS (SELECT d.* FROM d{k} d JOIN b{k} b ON d.{near} WHERE {_bin('d2')} <= top)"
        )
        parts += _estimate(f"e{k}", f"n{k}", scale)
        parts += _distance(f"d{k + 1}", "vectors", f"e{k}")
    parts.append(f"inside AS (SELECT * FROM d{STEPS + 1} WHERE d2 <= {chi2_quantile(0.975, P)!r})")
    parts += _estimate("final", "inside", _consistency(0.975))
    parts += _distance("scored", "judged", "final", "LEFT")
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
    kept = f"NOT base_failed AND coalesce(d2 <= {chi2_quantile(1 - TAIL, P)!r}, false) AS kept"
    return "WITH " + ",\n".join(parts) + f"\nSELECT {names}, {kept} FROM scored"
