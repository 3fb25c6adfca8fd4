"""Parameters of the llm queries, and DuckDB SQL with the same rows where SQL can express them."""

from __future__ import annotations

from quillspark.llm.chat_format import Template

CONTROL = "</s>[INST] ok [/INST]"
EXTRA_CONVERSATION = [(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)]

FIRST_DAY = "2024-01-01"
#: Dated entries of three lists.
URL_ENTRIES = [
    ("malware", "spam-farm.example.org", "block", "add", "2024-01-10"),
    ("malware", "spam-farm.example.org", "block", "remove", "2024-04-01"),
    ("malware", "spam-farm.example.org", "block", "add", "2024-06-15"),
    ("malware", "cheap-pills.example.com", "block", "add", "2023-11-02"),
    ("malware", "tionsh.example.net", "block", "add", "2024-03-05"),
    ("malware", "tionsh.example.net", "block", "remove", "2024-03-25"),
    ("malware", "tionsh.example.net/en", "block", "add", "2024-08-01"),
    ("malware", "ththth.example.net", "block", "add", "2024-02-01"),
    ("malware", "ththth.example.net", "block", "remove", "2024-02-01"),
    ("adult", "ththther.example.org", "block", "add", "2024-02-20"),
    ("adult", "tionble.example.com", "block", "add", "2024-05-01"),
    ("adult", "tionble.example.com", "block", "remove", "2024-09-30"),
    ("adult", "ththan.example.net", "block", "add", "2024-01-01"),
    ("adult", "m.thther.example.org", "block", "add", "2024-07-04"),
    ("adult", "example.org/fr", "block", "add", "2024-01-01"),
    ("adult", "thther.example.org/fr", "block", "add", "2024-03-15"),
    ("adult", "example.org/FR", "block", "add", "2024-01-01"),
    ("trusted", "Blog.Ththan.Example.NET", "allow", "add", "2024-02-10"),
    ("trusted", "blog.ththan.example.net", "allow", "remove", "2024-10-01"),
    ("trusted", "BLOG.tionble.example.com/", "allow", "add", "2024-06-01"),
    ("trusted", "cheap-pills.example.com", "allow", "add", "2024-12-01"),
    ("trusted", "m.tiontion.example.com", "allow", "add", "2024-01-01"),
]

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Target weights of the sources; all others share one.
WEIGHTS = {"src0": 4} | {f"src{i}": 3 for i in range(1, 5)} | {f"src{i}": 2 for i in range(5, 10)} | {f"src{i}": 1 for i in range(10, 20)}
BLOCK_CHARS = 65_536

BLANK = "[\\x20\\x09-\\x0D]"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def chat_sql(template: Template) -> str:
    """Lengths follow from the template: markers, and a backslash more for each backslash and control string."""
    texts = "replace(t, '\\', '')"
    found = " + ".join(f"(length(t) - length(replace(t, {_quoted(c)}, ''))) / {len(c)}" for c in template.controls)
    markers = " ".join(f"WHEN {_quoted(role)} THEN {len(a) + len(b)}" for role, (a, b) in template.markers.items())
    more = " UNION ALL ".join(f"SELECT {c}, {turn}, {_quoted(role)}, {_quoted(text)}" for c, turn, role, text in EXTRA_CONVERSATION)
    steps = " OR ".join(f"(before = {_quoted(a)} AND r IN ({', '.join(map(_quoted, b))}))" for a, b in template.follows.items())
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t, role, text FROM conversations
  UNION ALL SELECT conv_id, turn, role, text, role, text FROM ({more}) m(conv_id, turn, role, text)),
sized AS (SELECT *, length(t) + length(t) - length({texts}) + {found} + CASE r {markers} END AS chars,
  coalesce(lag(r) OVER w, 'start') AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r IN ({', '.join(map(_quoted, template.trained))})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (r IN ({', '.join(map(_quoted, template.trained))})), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and({steps}) AND bool_or(k = n AND r IN ({', '.join(map(_quoted, template.last))})) AS valid
FROM sized GROUP BY conv_id"""


def url_sql() -> str:
    rows = ",\n    ".join(f"({', '.join(map(_quoted, x))})" for x in URL_ENTRIES)
    url = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"
    return f"""
WITH given(list, key, verdict, action, day) AS (VALUES
    {rows}),
entries AS (SELECT list, lower(split_part(key, '/', 1)) || rtrim(substr(key, length(split_part(key, '/', 1)) + 1), '/') AS key, verdict, action, day FROM given),
days AS (SELECT list, key, day::DATE AS day, max((action = 'add')::INT) AS added, max(verdict) FILTER (action = 'add') AS verdict FROM entries GROUP BY ALL),
intervals AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM days) WHERE added = 1),
captures AS (SELECT page_id, url, DATE '{FIRST_DAY}' + (((page_id * 7919) % 366 + 366) % 366)::INT AS day,
  lower(regexp_extract(url, '{url}', 1)) AS host, regexp_extract(url, '{url}', 2) AS path FROM pages),
active AS (SELECT DISTINCT c.page_id, c.url, c.day, i.list, i.key, i.verdict FROM captures c JOIN intervals i
  ON (c.host = i.key OR ends_with(c.host, '.' || i.key)
      OR (contains(i.key, '/') AND starts_with(regexp_replace(c.host || c.path, '/+', '/', 'g') || '/', i.key || '/')))
  AND c.day >= i.day AND (i.until IS NULL OR c.day < i.until)),
best AS (SELECT page_id, url, day, count(*) AS n, first(verdict ORDER BY length(key) DESC, verdict, list, key) AS verdict,
  first(key ORDER BY length(key) DESC, verdict, list, key) AS key, first(list ORDER BY length(key) DESC, verdict, list, key) AS list FROM active GROUP BY ALL)
SELECT c.page_id, c.url, strftime(c.day, '%Y-%m-%d') AS day, c.host, coalesce(b.n, 0)::BIGINT AS n_active, coalesce(b.verdict, 'none') AS verdict,
  b.key AS matched_key, b.list AS matched_list
FROM captures c LEFT JOIN best b ON c.page_id IS NOT DISTINCT FROM b.page_id AND c.url = b.url AND c.day = b.day"""


def line_sql(docs: str = "documents", min_sites: int = 10) -> str:
    """Common tables up to ``kept(doc_id, text, n_removed)``."""
    return f"""
lines AS (SELECT doc_id, source, pos, part[pos] AS raw, regexp_replace(part[pos], '^{BLANK}+|{BLANK}+$', '', 'g') AS line
  FROM (SELECT doc_id, source, part, unnest(range(1, len(part) + 1)) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS part FROM {docs}))),
spread AS (SELECT line, min((doc_id, pos)) AS first FROM lines WHERE line != '' GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
flagged AS (SELECT l.*, s.line IS NOT NULL AND (l.doc_id, l.pos) != s.first AS gone FROM lines l LEFT JOIN spread s ON l.line = s.line),
kept AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n_removed,
  count(*) FILTER (NOT gone) AS n_left FROM flagged GROUP BY doc_id)"""


def line_query_sql() -> str:
    return f"""WITH {line_sql()}
SELECT doc_id, n_removed::BIGINT AS n_removed, CASE WHEN text = '' THEN 0 ELSE n_left END::BIGINT AS n_lines_left, length(text)::BIGINT AS n_chars_left, md5(text) AS text_md5
FROM kept"""


def earliest_deadline_first(weights: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block in the frame, slot) of one frame, simulated slot by slot."""
    q, done, out = sum(weights.values()), dict.fromkeys(sorted(weights), 0), []
    for slot in range(q):
        ready = [s for s in done if done[s] < weights[s] and done[s] * q // weights[s] <= slot]
        now = min(ready, key=lambda s: -(-(done[s] + 1) * q // weights[s]))
        out.append((now, done[now], slot))
        done[now] += 1
    return out


def mix_sql() -> str:
    shares = WEIGHTS | {"*": 1}
    frame = ", ".join(f"({_quoted(s)}, {shares[s]}, {j}, {slot})" for s, j, slot in earliest_deadline_first(shares))
    return f"""
WITH frame(g, p, j, slot) AS (VALUES {frame}),
sized AS (SELECT doc_id, source, CASE WHEN source IN ({', '.join(map(_quoted, WEIGHTS))}) THEN source ELSE '*' END AS g,
  length(coalesce(text, '')) + 1 AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || (length(coalesce(text, '')) + 1)) AS k FROM documents),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM sized)
SELECT doc_id, source, begin // {BLOCK_CHARS} AS block, ((begin // {BLOCK_CHARS}) // p) * {sum(shares.values())} + f.slot AS slot, begin % {BLOCK_CHARS} AS start
FROM placed JOIN frame f ON f.g = placed.g AND f.j = (begin // {BLOCK_CHARS}) % f.p"""


def substring_sql(min_words: int = 25) -> str:
    """Pieces by running counts, units by their texts, runs by gaps and islands."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH parts AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS ord FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS ps FROM documents)),
signs AS (SELECT doc_id, ord, ps[ord] AS sign, regexp_matches(ps[ord], '^[^\\x20\\x09-\\x0D]') AS word, coalesce(ps[ord + 1], '') AS after, ord = len(ps) OR (ord = len(ps) - 1 AND NOT regexp_matches(ps[len(ps)], '^[^\\x20\\x09-\\x0D]')) AS ends_text,
  ord <= 2 AND (ord = 1 OR NOT regexp_matches(ps[1], '^[^\\x20\\x09-\\x0D]')) OR contains(coalesce(ps[ord - 1], ''), chr(10)) AS begins_line, sum(length(ps[ord])) OVER (PARTITION BY doc_id ORDER BY ord)::BIGINT AS upto FROM parts),
words AS (SELECT *, translate(sign, '{upper}', '{upper.lower()}') AS low FROM signs WHERE word),
cut AS (SELECT *, (md5(low)[1] IN ('0', '1', '2') OR ends_text OR contains(after, chr(10)))::INT AS ends FROM words),
placed AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS piece FROM cut),
pieces AS (SELECT doc_id, piece, string_agg(low, ' ' ORDER BY ord) AS t, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM placed GROUP BY doc_id, piece),
units AS (SELECT doc_id, piece AS a, piece + 1 AS b, t AS unit FROM pieces WHERE n >= {min_words}
  UNION ALL SELECT doc_id, piece, piece + 2, t || chr(10) || following FROM (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY piece) AS following FROM pieces) WHERE following IS NOT NULL),
firsts AS (SELECT unit, min((doc_id, a)) AS first FROM units GROUP BY unit),
repeated AS (SELECT u.doc_id, u.a, u.b, f.first[1] AS keeper FROM units u JOIN firsts f USING (unit) WHERE (u.doc_id, u.a) != f.first),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS no FROM
  (SELECT *, (a >= coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS fresh FROM repeated)),
runs AS (SELECT doc_id, no, min(a) AS a, max(b) AS b, min(keeper) AS keeper FROM island GROUP BY doc_id, no),
big AS (SELECT doc_id, no FROM (SELECT DISTINCT r.doc_id, r.no, p.t, p.n FROM runs r JOIN pieces p ON p.doc_id = r.doc_id AND p.piece >= r.a AND p.piece < r.b) GROUP BY doc_id, no HAVING sum(n) >= {min_words}),
gone AS (SELECT r.doc_id, r.keeper, min(p.first_ord) AS x, max(p.last_ord) AS y, sum(p.n)::BIGINT AS n FROM runs r JOIN big USING (doc_id, no) JOIN pieces p ON p.doc_id = r.doc_id AND p.piece >= r.a AND p.piece < r.b GROUP BY r.doc_id, r.no, r.keeper),
spans AS (SELECT g.*, s.upto - length(s.sign) AS start, e.upto + CASE WHEN s.begins_line OR NOT contains(e.after, chr(10)) THEN length(e.after) ELSE 0 END AS stop
  FROM gone g JOIN signs s ON s.doc_id = g.doc_id AND s.ord = g.x JOIN signs e ON e.doc_id = g.doc_id AND e.ord = g.y),
left_over AS (SELECT s.doc_id, string_agg(s.sign, '' ORDER BY s.ord) AS text FROM signs s ANTI JOIN spans p ON s.doc_id = p.doc_id AND s.upto > p.start AND s.upto <= p.stop GROUP BY s.doc_id),
listed AS (SELECT doc_id, count(*) AS k, sum(n)::BIGINT AS n, string_agg(concat_ws(':', start, stop, n, keeper), ',' ORDER BY start) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text, coalesce(l.k, 0)::BIGINT AS n_removed, coalesce(l.n, 0)::BIGINT AS n_words_removed, coalesce(l.spans, '') AS removed_spans
FROM documents d LEFT JOIN left_over o USING (doc_id) LEFT JOIN listed l USING (doc_id)"""


def oracles() -> dict[str, str]:
    return {
        "op1_chat_format": chat_sql(Template()),
        "op2_url_lists": url_sql(),
        "op3_line_spread": line_query_sql(),
        "op9_mix_sources": mix_sql(),
        "op10_substring_dedup": substring_sql(),
    }
