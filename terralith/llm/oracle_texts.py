"""Independent SQL texts (DuckDB) of the operators' queries, written from their definitions, with no hash, index or filter."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Smallest node reachable over links (a, b), given in both directions; nodes without a link are left out.
REACHED = """reach AS (SELECT a, a AS b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        component AS (SELECT a AS node, min(b) AS least FROM reach GROUP BY a)"""

OP1 = f"""
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        sound AS MATERIALIZED (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        link AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM sound p JOIN sound q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.9),
        {REACHED},
        many AS (SELECT a AS node, count(*) AS n FROM link GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
    FROM v LEFT JOIN many ON vec_id = many.node LEFT JOIN component ON vec_id = component.node
"""

OP3 = rf"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingle AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM words, unnest(range(1, greatest(2, len(w) - 3))) t(i) WHERE len(w) > 0),
        size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        met AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM shingle p JOIN shingle q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL),
        link AS MATERIALIZED (SELECT a, b FROM met JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * met.n >= 80 * (x.n + y.n - met.n)),
        {REACHED}
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id
    FROM documents d LEFT JOIN size ON d.doc_id = size.doc_id LEFT JOIN component ON d.doc_id = component.node
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Matches of one kind with their places: what stands between the matches and the matches before give the start."""
    return f"""SELECT row, repo, source, '{kind}' AS kind, {place} AS o, m[i] AS whole, v[i] AS value,
            (list_sum(list_transform(parts[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0))::BIGINT AS start
        FROM (SELECT row, repo, source, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS parts FROM t), unnest(range(1, len(m) + 1)) u(i)
        WHERE length(v[i]) >= {least}"""


OP4 = f"""
    WITH t AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, concat_ws('/', source, lang) AS repo FROM documents),
        base AS MATERIALIZED ({_kind("assign", 0, ASSIGN, 2, 6)} UNION ALL {_kind("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_kind("hex", 2, "[0-9a-f]+", 0, 24)}),
        verdict AS (SELECT value, CASE WHEN count(DISTINCT source) <= 1 AND count(DISTINCT repo) <= 1 THEN 'live' ELSE 'example' END AS verdict FROM base GROUP BY value),
        span AS (SELECT row, kind, o, start, start + length(whole) AS stop FROM base
            UNION SELECT row, verdict, CASE verdict WHEN 'live' THEN 3 ELSE 4 END, start, start + length(whole) FROM base JOIN verdict USING (value)),
        own AS (SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
                count(*) FILTER (WHERE kind = 'live') AS n_live, count(*) FILTER (WHERE kind = 'example') AS n_example,
                string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, o, stop) AS spans, string_agg(CASE WHEN o < 3 THEN concat_ws(':', kind, start, stop) END, ',' ORDER BY start, o, stop) AS base FROM span GROUP BY row)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
    FROM t LEFT JOIN own USING (row)
"""


def op7(masks, span: int, stretch: int, equal: int) -> str:
    """Seeds are compared as the words themselves; around a hit all aligned words are compared."""
    join = lambda ks: "concat_ws(' ', " + ", ".join(f"w[i + {k}]" for k in ks) + ")"
    one = lambda table, m, ks, where: f"SELECT id, {m} AS m, unnest(list_transform(range(1, n - {ks[-1]} + 1), lambda i: {{{{'i': i, 'seed': {join(ks)}}}}}), recursive := true) FROM {table} WHERE {where}"
    least = len(masks[0])
    whole = [tuple(range(n)) for n in range(1, least)]  # items of fewer words: all of them
    seeds = lambda table, of_items: " UNION ALL ".join([*(one(table, m, ks, f"n > {ks[-1]} AND n >= {least}" if of_items else f"n > {ks[-1]}") for m, ks in enumerate(masks)), *(one(table, -len(ks), ks, f"n = {len(ks)}" if of_items else f"n >= {len(ks)} AND (SELECT count(*) FROM item_text WHERE n = {len(ks)}) > 0") for ks in whole)]).replace("{{", "{").replace("}}", "}")
    words = lambda name, key, table: rf"{name}_text AS MATERIALIZED (SELECT {key} AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w, len(w) AS n FROM {table})"
    size = f"least({stretch}, item_n)"
    return f"""
    WITH {words("doc", "doc_id", "documents")}, {words("item", "item_id", "benchmark")},
        item_seed AS MATERIALIZED ({seeds("item_text", True)}), doc_seed AS ({seeds("doc_text", False)}),
        met AS MATERIALIZED (SELECT d.id AS doc_id, d.i AS i, m.id AS item_id, m.i AS j FROM doc_seed d JOIN item_seed m USING (m, seed)),
        hit AS (SELECT doc_id, item_id, i, j, d.w AS a, t.w AS b, t.n AS item_n FROM met JOIN doc_text d ON doc_id = d.id JOIN item_text t ON item_id = t.id),
        same AS (SELECT doc_id, item_id, item_n, list_transform(range({1 - stretch}, {span + stretch - 1}), lambda k: CASE WHEN i + k >= 1 AND j + k >= 1 AND a[i + k] = b[j + k] THEN 1 ELSE 0 END) AS e FROM hit),
        most AS (SELECT doc_id, item_id, {size} AS size, list_max(list_transform(range(1, len(e) - {size} + 2), lambda k: list_sum(e[k : k + {size} - 1]))) AS equal FROM same)
    SELECT doc_id, item_id, max(equal)::INT AS equal FROM most WHERE equal * 100 >= size * {equal} GROUP BY doc_id, item_id
"""


def op9(templates: list[tuple[str, str]], threshold: float, notices: int, file_name: str) -> str:
    """Every line and every whole text is held against every template; licences are looked up directory by directory."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(templates))
    terms = lambda c: rf"regexp_extract_all(translate({c}, '{UPPER}', '{LOWER}'), '[\p{{L}}\p{{N}}]+')"
    parent = lambda c: f"CASE WHEN contains({c}, '/') THEN regexp_replace({c}, '/[^/]*$', '') ELSE '' END"
    return f"""
    WITH template(i, name, text) AS (VALUES {values}),
        tt AS MATERIALIZED (SELECT i, name, term, count(*) AS n FROM (SELECT i, name, unnest({terms("text")}) AS term FROM template) GROUP BY ALL),
        d AS MATERIALIZED (SELECT doc_id, text, concat_ws('/', source, lang, doc_id) AS path FROM documents),
        total AS (SELECT count(*) AS n FROM d),
        found AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({terms("coalesce(text, '')")}) AS term FROM d) WHERE term IN (SELECT term FROM tt) GROUP BY term),
        idf AS MATERIALIZED (SELECT v.term, ln((1 + total.n) / (1 + coalesce(found.n, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) v CROSS JOIN total LEFT JOIN found ON v.term = found.term),
        entry AS (SELECT i, name, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY i)) AS w FROM tt JOIN idf USING (term)),
        unit AS (SELECT doc_id, 0 AS kind, text AS unit FROM d WHERE text IS NOT NULL UNION SELECT doc_id, 1, unnest(string_split(text, chr(10))) FROM d WHERE text IS NOT NULL),
        tf AS (SELECT doc_id, kind, unit, term, count(*) AS tf FROM (SELECT doc_id, kind, unit, unnest({terms("unit")}) AS term FROM unit) GROUP BY ALL),
        x AS MATERIALIZED (SELECT doc_id, kind, md5(unit) AS unit, term, idf.term IS NOT NULL AS known, tf * coalesce(idf, (SELECT ln(1 + n) + 1 FROM total)) AS x FROM tf LEFT JOIN idf USING (term)),
        norm AS (SELECT doc_id, kind, unit, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL HAVING bool_or(known)),
        dot AS (SELECT doc_id, kind, unit, i, name, sum(x * w) AS dot FROM x JOIN entry USING (term) GROUP BY ALL),
        score AS (SELECT doc_id, kind, i, name, round(dot / norm, 9) AS score FROM dot JOIN norm USING (doc_id, kind, unit) WHERE dot / norm >= {threshold}),
        line AS (SELECT doc_id, name FROM score QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind, name) = 1),
        file AS (SELECT doc_id, name FROM score JOIN d USING (doc_id) WHERE kind = 0 AND i >= {notices} OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), '{file_name}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind, score DESC, name) = 1),
        own AS (SELECT line.doc_id, coalesce(file.name, line.name) AS license, best.score, file.name AS whole FROM line LEFT JOIN file USING (doc_id) JOIN (SELECT doc_id, max(score) AS score FROM score GROUP BY doc_id) best USING (doc_id)),
        folder AS (SELECT {parent("path")} AS dir, min(whole) AS license FROM own JOIN d USING (doc_id) WHERE whole IS NOT NULL GROUP BY 1),
        above AS (SELECT d.doc_id, f.dir, f.license, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(f.dir) DESC) AS k FROM d JOIN folder f ON f.dir = '' OR {parent("d.path")} = f.dir OR starts_with({parent("d.path")}, f.dir || '/'))
    SELECT d.doc_id, d.path, coalesce(own.license, above.license) AS license, own.score,
           CASE WHEN own.whole IS NOT NULL THEN 'file' WHEN own.license IS NOT NULL THEN 'header' WHEN above.license IS NOT NULL THEN 'inherited' END AS found_in, CASE WHEN own.license IS NULL THEN above.dir END AS license_dir
    FROM d LEFT JOIN own ON d.doc_id = own.doc_id LEFT JOIN above ON d.doc_id = above.doc_id AND above.k = 1
"""


# Every phrase is counted; no bucket, bitmap or pruning.
OP11 = rf"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        words AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
        one AS MATERIALIZED (SELECT lang, w1, count(*) AS n FROM (SELECT lang, unnest(w) AS w1 FROM words) GROUP BY ALL),
        two AS MATERIALIZED (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS n FROM words, unnest(range(1, len(w))) t(i) GROUP BY ALL HAVING count(*) >= 10),
        three AS MATERIALIZED (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS n FROM words, unnest(range(1, len(w) - 1)) t(i) GROUP BY ALL HAVING count(*) >= 10),
        total AS (SELECT lang, sum(n)::BIGINT AS n FROM one GROUP BY lang),
        pair AS (SELECT two.lang, two.w1, two.w2, concat_ws(' ', two.w1, two.w2) AS phrase, two.n AS a, x.n AS l, y.n AS r, (1000000::HUGEINT * two.n * two.n // (x.n::HUGEINT * y.n))::BIGINT AS score
            FROM two JOIN one x ON two.lang = x.lang AND two.w1 = x.w1 JOIN one y ON two.lang = y.lang AND two.w2 = y.w1),
        cut AS (SELECT t.lang, t.w1, t.w2, t.w3, t.n AS a, 1 AS k, x.n AS l, y.n AS r FROM three t JOIN one x ON t.lang = x.lang AND t.w1 = x.w1 JOIN two y ON t.lang = y.lang AND t.w2 = y.w1 AND t.w3 = y.w2
            UNION ALL SELECT t.lang, t.w1, t.w2, t.w3, t.n, 2, x.n, y.n FROM three t JOIN two x ON t.lang = x.lang AND t.w1 = x.w1 AND t.w2 = x.w2 JOIN one y ON t.lang = y.lang AND t.w3 = y.w1),
        triple AS (SELECT lang, concat_ws(' ', w1, w2, w3) AS phrase, a, l, r, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY 1000000::HUGEINT * a * a // (l::HUGEINT * r), k) = 1),
        around AS (SELECT lang, w1, w2, max(n) AS n FROM (SELECT lang, w1, w2, n FROM three UNION ALL SELECT lang, w2, w3, n FROM three) GROUP BY ALL),
        every AS (SELECT p.lang, phrase, a, l, r, score FROM pair p LEFT JOIN around o ON p.lang = o.lang AND p.w1 = o.w1 AND p.w2 = o.w2 WHERE 100 * coalesce(o.n, 0) < 50 * a UNION ALL FROM triple),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank FROM every)
    SELECT lang, rank, phrase, a, l, r, total.n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op13(rounds: int) -> str:
    """Every part meets every entry in every round."""
    books, last = [], rounds
    far = "list_sum(list_transform(range(1, len(a.z) + 1), lambda i: (a.z[i] - b.z[i]) * (a.z[i] - b.z[i])))::BIGINT"
    for k in range(last + 1):
        books.append(f"near{k} AS MATERIALIZED (SELECT row, p, a.z, b.e, {far} AS d FROM part a JOIN book{k} b USING (p) QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY {far}, b.e) = 1)")
        if k < last:
            books.append(f"""sum{k} AS (SELECT p, e, j, sum(z[j])::BIGINT AS s, count(*) AS n FROM near{k}, unnest(range(1, len(z) + 1)) t(j) GROUP BY ALL),
        mean{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS z FROM sum{k} GROUP BY p, e),
        book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.z, b.z) AS z FROM book{k} b LEFT JOIN mean{k} m USING (p, e))""")
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS z FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        part AS MATERIALIZED (SELECT row, vec_id, p, z[p * len(z) // 16 + 1 : (p + 1) * len(z) // 16] AS z FROM v, range(16) t(p)),
        book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, row) - 1 AS e, z FROM part QUALIFY e < 64),
        {", ".join(books)},
        row AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{last} GROUP BY row),
        digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(z) AS x, generate_subscripts(z, 1) AS j FROM book{last}))
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN row USING (row), digest
"""
