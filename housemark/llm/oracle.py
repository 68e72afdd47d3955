"""DuckDB SQL of the operators that SQL can express."""

from housemark.llm import mixing, quality_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def mixing_sql() -> str:
    weights = ", ".join(f"{w:.1f}" for w in mixing.WEIGHTS)
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS}) AS size,
         md5(concat('{mixing.SEED}:', coalesce(doc_id::VARCHAR, ''))) AS tie
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source
), placed AS (
  SELECT *, {mixing.MOST_COPIES} * source_size::DOUBLE AS most,
         [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]
           ::DOUBLE AS weight
  FROM sources
), levels AS (
  SELECT *, ({mixing.SHARE}::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER earlier, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM placed
  WINDOW earlier AS (ORDER BY most / weight, source NULLS FIRST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shared AS (
  SELECT *, level * weight >= most AS is_full,
         max(level) FILTER (WHERE level * weight < most) OVER () AS shared FROM levels
), targets AS (
  SELECT source, source_size, n,
         CASE WHEN is_full THEN most ELSE shared * weight END AS target,
         ('0x' || substr(md5(concat('{mixing.SEED}:offset:', coalesce(source, ''))), 1, 8))::BIGINT
           / 4294967296.0::DOUBLE AS start
  FROM shared
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, tie) AS rank FROM sized
), positions AS (
  SELECT r.doc_id, r.size, t.*,
         CASE WHEN rank % 2 = 1 THEN rank // 2 + 1 ELSE n - rank // 2 + 1 END AS place,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (floor(start + place * expected) - floor(start + (place - 1) * expected))::BIGINT
            AS copies
  FROM positions
)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies * size::BIGINT AS taken, copies
FROM taken"""


def quality_rules_sql() -> str:
    n = len(quality_rules.SPREADS)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    group = "lang, source"
    keys = "lang, source, start"
    join = "r.lang IS NOT DISTINCT FROM e.lang AND r.source IS NOT DISTINCT FROM e.source"
    counts = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    vector = ", ".join(
        f"round(1000 * ln(1 + {c} / greatest(n_words, 1)::DOUBLE))::DOUBLE AS x{i}"
        for i, c in enumerate(counts)
    )

    def factors(source: str) -> str:
        steps = []
        columns = f"{keys}, " + ", ".join(f"m{i}" for i in range(n))
        weight = f"(n + {quality_rules.SPREAD_ROWS!r})"
        sums = {(i, j): f"s{i}{j} / {weight}" for i, j in pairs}
        for i, spread in enumerate(quality_rules.SPREADS):
            own = f"(s{i}{i} + {quality_rules.SPREAD_ROWS * spread**2!r}) / {weight}"
            sums[i, i] = f"greatest({own}, {quality_rules.LEAST_PART * spread**2!r})"
        inner = source
        for i, j in sorted(pairs, key=lambda x: (x[1], x[0])):
            rest = sums[i, j] + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            value = f"sqrt({rest})" if i == j else f"({rest}) / l{j}{j}"
            inner = f"(SELECT *, {value} AS l{i}{j} FROM {inner})"
            steps.append(f"l{i}{j}")
        root = " + ".join(f"ln(l{i}{i})" for i in range(n))
        return f"SELECT {columns}, {', '.join(steps)}, {root} AS log_root FROM {inner}"

    def moments(near: str) -> str:
        return (
            f"(SELECT {keys}, n, "
            + ", ".join(f"t{i} / n AS m{i}" for i in range(n))
            + ", "
            + ", ".join(f"p{i}{j} - t{i} * t{j} / n AS s{i}{j}" for i, j in pairs)
            + f" FROM (SELECT {keys}, count(*)::DOUBLE AS n, "
            + ", ".join(f"sum(x{i}) AS t{i}" for i in range(n))
            + ", "
            + ", ".join(f"sum(x{i} * x{j}) AS p{i}{j}" for i, j in pairs)
            + f" FROM {near} GROUP BY {keys}))"
        )

    solved: list[str] = []
    for i in range(n):
        rest = f"(x{i} - m{i}" + "".join(f" - l{i}{j} * {y}" for j, y in enumerate(solved)) + ")"
        solved.append(f"({rest} / l{i}{i})")
    distance = " + ".join(f"{y} * {y}" for y in solved)
    start = (
        f"(SELECT {group}, 0 AS start, 0::DOUBLE AS n, "
        + ", ".join(f"quantile_cont(x{i}, 0.5) AS m{i}" for i in range(n))
        + ", "
        + ", ".join(f"0::DOUBLE AS s{i}{j}" for i, j in pairs)
        + f" FROM vectors GROUP BY {group})"
    )
    everything = moments("(SELECT *, 1 AS start FROM vectors)")
    parts = [f"estimate0 AS MATERIALIZED ({factors(start)} UNION ALL {factors(everything)})"]
    for step in range(quality_rules.STEPS):
        parts += [
            f"binned{step} AS MATERIALIZED (SELECT r.*, start, floor(64 * ln(1 + ({distance}))) AS bin "
            f"FROM vectors r JOIN estimate{step} e ON {join})",
            f"near{step} AS MATERIALIZED (SELECT r.* FROM binned{step} r JOIN (SELECT {keys}, "
            f"quantile_cont(bin, {quality_rules.KEPT_PART}) AS most FROM binned{step} "
            f"GROUP BY {keys}) e ON {join} AND r.start = e.start AND bin <= most)",
            f"estimate{step + 1} AS MATERIALIZED ({factors(moments(f'near{step}'))})",
        ]
    every = " UNION ALL ".join(
        f"SELECT *, {step} AS step FROM estimate{step + 1}" for step in range(quality_rules.STEPS)
    )
    parts.append(
        f"least AS MATERIALIZED (SELECT DISTINCT ON ({group}) * FROM ({every}) "
        f"ORDER BY {group}, round(log_root, 9), step, start)"
    )
    return rf"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, lang, source, {_WORDS} AS w,
         coalesce(text, '') AS text FROM documents
), windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, a) AS n
  FROM (SELECT row, i, [w[i], w[i + 1], w[i + 2]] AS a
        FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM texts))
), repeated AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p
                                           FROM windows WHERE n > 1) GROUP BY row
), counted AS MATERIALIZED (
  SELECT t.doc_id, t.lang, t.source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, md5(text) AS text_key
  FROM (SELECT *, list_filter(string_split(text, chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM texts) t
  LEFT JOIN repeated r USING (row)
), judged AS MATERIALIZED (
  SELECT *, n_words < {quality_rules.LEAST_WORDS}
            OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED_PERCENT} * n_words AS base_failed,
         {vector} FROM counted
), vectors AS MATERIALIZED (
  SELECT lang, source, {", ".join(f"x{i}" for i in range(n))}
  FROM (SELECT DISTINCT lang, source, text_key, {", ".join(f"x{i}" for i in range(n))}
        FROM judged WHERE NOT base_failed)
), {", ".join(parts)}
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(({distance}) / {quality_rules.CORRECTION}
                                    <= {quality_rules.MOST_DISTANCE}, false) AS kept
FROM judged r LEFT JOIN least e ON {join}"""


def filter_audit_sql() -> str:
    """Each document is judged alone, then held against every order by plain joins."""
    return rf"""
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS words
    FROM documents
), marked AS (
    SELECT doc_id, part,
        (len(words) < 200)::INT
        + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
    FROM docs
), of_id AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1
), cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM marked LEFT JOIN of_id USING (doc_id) GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT o.filter_order, s.step, l.x, l.b, coalesce(sum(e.b), 0)::INT AS earlier
    FROM orders o CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
    JOIN letters l ON l.x = substr(o.filter_order, s.step, 1)
    LEFT JOIN letters e ON strpos(o.filter_order, e.x) < s.step
    GROUP BY ALL
), counted AS (
    SELECT part, filter_order, step, x,
        sum(CASE WHEN mask & (b | earlier) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & b <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & b <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & b <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & b <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells CROSS JOIN steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
    redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""


def merkle_sql() -> str:
    """Trees level by level and every leaf's way up, in recursive queries."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")

    def leaf(changed: str = "n_chars") -> str:
        texts = [f"({changed if x == 'n_chars' else x})::VARCHAR" for x in fields]
        parts = [f"coalesce(strlen({t})::VARCHAR || ':' || {t}, '-')" for t in texts]
        return f"sha256({' || '.join(parts)})"

    bits = """CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"""
    byte = f"list_reduce([xor(c, b)] || range(8), lambda x, k: {bits})"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    crc = f"xor(list_reduce([4294967295] || {digits}, lambda c, b: {byte}), 4294967295)"
    return f"""
WITH RECURSIVE leaves AS (
    SELECT row_number() OVER () AS r, doc_id, lang, {leaf()} AS leaf,
        CASE WHEN {crc} % 7 = 0 THEN {leaf("n_chars::HUGEINT + 1")} ELSE {leaf()} END AS forged
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
        count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS p
    FROM leaves
), tree(p, level, i, n, digest) AS (
    SELECT p, 0, i, n, leaf FROM placed
    UNION ALL
    SELECT p, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
    FROM tree WHERE n > 1 GROUP BY p, level, i // 2, n
), tops(level, i, n, digest) AS (
    SELECT 0, p, (SELECT count(*) FROM tree WHERE n = 1), digest FROM tree WHERE n = 1
    UNION ALL
    SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
    FROM tops WHERE n > 1 GROUP BY level, i // 2, n
), way(r, p, level, i, n, digest, proof) AS (
    SELECT r, p, 0, i, n, forged, '' FROM placed
    UNION ALL
    SELECT w.r, w.p, w.level + 1, w.i // 2, (w.n + 1) // 2,
        CASE WHEN w.i % 2 = 1 THEN sha256(t.digest || w.digest)
             ELSE sha256(w.digest || coalesce(t.digest, '')) END,
        w.proof || coalesce(t.digest, '')
    FROM way w LEFT JOIN tree t ON t.p = w.p AND t.level = w.level AND t.i = xor(w.i, 1)
    WHERE w.n > 1
), over_parts(r, p, level, i, n, digest, proof) AS (
    SELECT r, p, 0, p, (SELECT max(n) FROM tops), digest, proof FROM way WHERE n = 1
    UNION ALL
    SELECT w.r, w.p, w.level + 1, w.i // 2, (w.n + 1) // 2,
        CASE WHEN w.i % 2 = 1 THEN sha256(t.digest || w.digest)
             ELSE sha256(w.digest || coalesce(t.digest, '')) END,
        w.proof || coalesce(t.digest, '')
    FROM over_parts w LEFT JOIN tops t ON t.level = w.level AND t.i = xor(w.i, 1)
    WHERE w.n > 1
)
SELECT doc_id, leaf, s.digest AS subroot, o.digest AS root, sha256(w.proof) AS proof_sha256,
    w.digest AS folded_root, w.digest = o.digest AS verified
FROM placed JOIN over_parts w USING (r)
JOIN tree s ON s.p = placed.p AND s.n = 1
JOIN tops o ON o.n = 1
WHERE w.n = 1
"""
