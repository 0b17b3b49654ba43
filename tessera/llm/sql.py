"""DuckDB SQL of the queries that SQL can express over whole tables."""

_LEAF = r"(?:[^ \n]*[^ \ne.,] +){0,15}[^ \n]+ *| +"


def _near(x: str, y: str) -> str:
    """Likeness of the trees x and y (numbers of the texts): leaves under equal paragraphs at one place, and distinct ones under the others."""
    same = f"coalesce(list_sum(list_transform(list_filter(range(1, least(len(p{x}), len(p{y})) + 1), lambda j: p{x}[j] = p{y}[j]), lambda j: len(l{x}[j]))), 0)"
    rest = lambda a, b: f"list_distinct(flatten(list_transform(list_filter(range(1, len(p{a}) + 1), lambda j: j > len(p{b}) OR p{a}[j] <> p{b}[j]), lambda j: l{a}[j])))"
    return f"""CASE WHEN r{x} = r{y} THEN 1.0::DOUBLE WHEN 2 * {same} + len({rest(x, y)}) + len({rest(y, x)}) = 0 THEN 0.0::DOUBLE
    ELSE (2 * {same} + 2 * len(list_intersect({rest(x, y)}, {rest(y, x)})))::DOUBLE / (2 * {same} + len({rest(x, y)}) + len({rest(y, x)})) END"""


_HASHED = "list_transform(range(0, len({p}), 8), lambda i: sha256('S' || array_to_string({p}[i + 1 : i + 8], '|')))"
_ROOT = "sha256('R' || len({p}) || '|' || array_to_string(" + _HASHED + ", '|'))"

#: Merkle trees as nested hashes; leaves as strings, of which only the numbers in common count.
OP3 = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), near AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM base WINDOW w AS (ORDER BY doc_id)
), edited AS (
  SELECT *, left(text, n - n // 4) || left(next_text, n // 4) AS edited FROM near
), split AS (
  SELECT *, string_split(text, chr(10)) AS t0, string_split(edited, chr(10)) AS t1, string_split(next_text, chr(10)) AS t2 FROM edited
), parts AS (
  SELECT *, {", ".join(f"list_transform(t{i}, lambda p: sha256('P' || p)) AS p{i}, list_transform(t{i}, lambda p: regexp_extract_all(p, '{_LEAF}')) AS l{i}" for i in "012")} FROM split
), roots AS (
  SELECT *, {", ".join(_ROOT.format(p=f"p{i}") + f" AS r{i}" for i in "012")},
    list_filter(range(1, greatest(len(p0), len(p1)) + 1), lambda j: p0[j] IS DISTINCT FROM p1[j]) AS places FROM parts
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, r0 AS fingerprint, r1 AS edited_fingerprint,
  {_near("0", "1")} AS near_edited, {_near("0", "2")} AS near_next, (places[1] - 1)::BIGINT AS first_edited, len(places)::BIGINT AS n_edited
FROM roots
"""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: The level rises until no source is newly full; copies are the integers crossed by the prefix sum.
OP4 = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS key, {_WORDS}::BIGINT AS size FROM documents
), sources AS (
  SELECT key, sum(size)::BIGINT AS source_size, (3.0::DOUBLE * sum(size)::BIGINT) AS most,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY key, source
), levels AS (
  SELECT 0 AS round, (SELECT sum(source_size) / sum(weight) FROM sources)::DOUBLE AS level
  UNION ALL
  SELECT round + 1, ((SELECT sum(source_size)::BIGINT FROM sources) - sum(CASE WHEN weight * level > most THEN most ELSE 0 END))::DOUBLE
    / sum(CASE WHEN weight * level > most THEN 0 ELSE weight END)
  FROM levels, sources GROUP BY round, level HAVING round < 40
), targets AS (
  SELECT key, source_size, least(weight * (SELECT level FROM levels ORDER BY round DESC LIMIT 1), most) AS target FROM sources
), dealt AS (
  SELECT *, length(bin(size)) * 4 + CASE WHEN length(bin(size)) >= 3 THEN (size >> (length(bin(size)) - 3)::BIGINT) & 3 ELSE 0 END AS class,
    (coalesce(doc_id, 0) + coalesce(doc_id, 0) // 64 + coalesce(doc_id, 0) // 4096) % (64 * (1 + (SELECT count(*) FROM sized) // 4000000)) AS part
  FROM sized
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY class, part, doc_id NULLS FIRST, size) - 1 AS position FROM dealt
), rated AS (
  SELECT placed.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(key), 1, 4))::BIGINT / 65536.0::DOUBLE AS first
  FROM placed JOIN targets USING (key)
), tried AS (
  SELECT key, k, (first + k / 16.0::DOUBLE) % 1.0::DOUBLE AS offs,
    abs(sum(size * least(floor((first + k / 16.0::DOUBLE) % 1.0::DOUBLE + (position + 1) * rate) - floor((first + k / 16.0::DOUBLE) % 1.0::DOUBLE + position * rate), ceil(rate))) - any_value(target)) AS error
  FROM rated, range(16) t(k) GROUP BY key, k, first
), chosen AS (
  SELECT key, offs FROM tried QUALIFY row_number() OVER (PARTITION BY key ORDER BY error, k) = 1
)
SELECT doc_id, size, source_size, target,
  (size * least(floor(offs + (position + 1) * rate) - floor(offs + position * rate), ceil(rate)))::BIGINT AS taken
FROM rated JOIN chosen USING (key)
"""

_ESCAPED = r"replace(replace(replace(coalesce({0}, ''), '\', '\\'), '<', '<\'), '[', '[\')"

OP10 = f"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM said
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS turns,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss,
    sum(19 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""

SQL: dict[str, str] = {"op3_merkle_fingerprints": OP3, "op4_source_mixing": OP4, "op10_reply_trees": OP10}

#: Shingles by their words, all pairs that share one, and reachability.
OP1 = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), node AS (
  SELECT min(row) AS node, min(doc_id) AS rep, sorted, len(sorted) AS n FROM (SELECT *, list_sort(s) AS sorted FROM sets) WHERE len(s) > 0 GROUP BY sorted
), item AS (
  SELECT node, n, unnest(sorted) AS s FROM node
), link AS (
  SELECT a.node AS a, b.node AS b FROM item a JOIN item b ON a.s = b.s AND a.node <> b.node AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT node AS a, node AS b FROM node UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), class AS (
  SELECT reach.a AS node, min(rep) AS component_id FROM reach JOIN node ON reach.b = node.node GROUP BY reach.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM (SELECT *, list_sort(s) AS sorted FROM sets) LEFT JOIN node USING (sorted) LEFT JOIN class USING (node)
"""

SQL["op1_parity_join"] = OP1
