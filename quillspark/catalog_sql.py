"""DuckDB SQL with the rows of the catalogue's queries, written on its own: by windows where the engine uses array
functions, by recursion where it iterates."""

from __future__ import annotations

from quillspark.functions.fixed import CITATION_STOPWORDS, CODE_HOSTS, DATA_PHRASES, KINDS, QUESTIONS, SOFTWARE_PHRASES
from quillspark.functions.scoring import LICENSES, OWNING, USING, VERSION
from quillspark.functions.text import ABBREVIATIONS, URL_PATTERN

#: Fixture lexicon: a case variant, a phrase of two kinds, inner signs and a phrase that ends in signs.
LEXICON = [
    (0, "license", "dataset"), (1, "version", "software"), (2, "of the", "dataset"), (3, "the", "software"), (4, "The", "software"), (5, "MIT License", "gaz_dataset"), (6, "Apache License", "gaz_method"),
    (6, "Apache License", "gaz_dataset"), (7, "GNU General Public License", "gaz_method"), (8, "CC BY-NC", "gaz_dataset"), (9, "C++", "gaz_method"),
]
ARTIFACT_LEXICON = [x for x in LEXICON if x[0] not in (2, 3, 4)]

CITED = " as (Smith 2019) or [Doe et al. 2020] and [12] with ( 7 ) in (Fig 3) [Roe 2001] (see Table 4)."
URL_TAIL = ", https://github.com/a/b. Or 1.2.3.4 and docs.example.org/x, item "
MARKS = " as in [12] and (Smith 2019)"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else q(x) for x in r) + ")" for r in rows)


PARS = """pars AS (SELECT doc_id, pos - 1 AS par, part[pos] AS line FROM (SELECT doc_id, part, unnest(range(1, len(part) + 1)) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS part FROM documents)))"""
_short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
SENTS = PARS + f""",
cut AS (SELECT doc_id, par, list_filter(list_transform(string_split(regexp_replace(regexp_replace(line, '\\b({_short})\\.\\s+', '\\1.␟', 'g'), '([.!?]+)\\s+', '\\1␞', 'g'), '␞'),
  lambda x: replace(x, '␟', ' ')), lambda x: trim(x) != '') AS ss FROM pars),
sents AS (SELECT doc_id, par, pos - 1 AS sent, ss[pos] AS text FROM (SELECT doc_id, par, ss, unnest(range(1, len(ss) + 1)) AS pos FROM cut))"""


def spans(rows, sents: str = "sents") -> str:
    """found(doc_id, par, sent, text, kind, phrase, rank, st, en): n-grams of running windows over tokens."""
    return f"""
lex(rank, phrase, kind) AS (VALUES {values(rows)}),
pieces AS (SELECT doc_id, par, sent, text, i, ps[i] AS piece FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM
  (SELECT *, regexp_extract_all(lower(text), '[\\pL\\pM\\pN_]+|[^\\pL\\pM\\pN_]+') AS ps FROM {sents}))),
placed AS (SELECT *, (sum(length(piece)) OVER w - length(piece))::INT AS st, list(piece) OVER (PARTITION BY doc_id, par, sent ORDER BY i ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS win
  FROM pieces WINDOW w AS (PARTITION BY doc_id, par, sent ORDER BY i)),
grams AS (SELECT doc_id, par, sent, text, st, unnest(list_transform(range(1, len(win) + 1, 2), lambda n: array_to_string(win[1:n], ''))) AS gram
  FROM placed WHERE regexp_matches(piece, '^[\\pL\\pM\\pN_]')),
found AS (SELECT g.doc_id, g.par, g.sent, g.text, l.kind, l.phrase, l.rank, g.st, g.st + length(gram)::INT AS en FROM grams g JOIN lex l ON g.gram = lower(l.phrase))"""


TYPE = "CASE kind WHEN 'gaz_dataset' THEN 'dataset' WHEN 'gaz_method' THEN 'software' ELSE kind END"
NUMBERED = f"""
numbered AS (SELECT *, {TYPE} AS type, text[1:st] || '<m>' || text[st + 1:en] || '</m>' || text[en + 1:] AS annotated,
  (row_number() OVER (PARTITION BY doc_id ORDER BY par, sent, st, en, list_position([{', '.join(map(q, KINDS))}], kind), rank, phrase) - 1)::INT AS cand_no FROM found)"""
_url = "list_transform(regexp_extract_all(text, " + q(URL_PATTERN) + "), lambda u: regexp_replace(u, '[.(){}\\[\\]<>,:!@$%^&*;]$', ''))"
_no_noise = "NOT regexp_matches(u, '^(?:\\d+\\.?)+$') AND NOT regexp_matches(u, '^\\d+\\.\\w+$') AND NOT starts_with(u, 'i.e') AND NOT starts_with(u, 'et.al') AND NOT starts_with(u, 'e.g') AND NOT starts_with(u, 'al.') AND NOT ends_with(u, '.et')"
_keywords = ", ".join(map(q, DATA_PHRASES + SOFTWARE_PHRASES))
MENTIONS = f"""
urled AS (SELECT *, list_filter({_url}, lambda u: {_no_noise}) AS urls FROM numbered),
asked AS (SELECT *, round(0.15 + CASE WHEN regexp_matches(text, {q(LICENSES)}) THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(text, {q(VERSION)}) THEN 0.2 ELSE 0 END
  + CASE WHEN regexp_matches(text, '\\b[A-Z]{{2,}}\\b') THEN 0.1 ELSE 0 END + CASE WHEN starts_with(kind, 'gaz_') THEN 0.2 ELSE 0 END, 6)::DOUBLE AS artifact_yes,
  CASE WHEN starts_with(kind, 'gaz_') THEN text[st + 1:en] ELSE nullif(regexp_extract(text[1:st], '([A-Z][A-Za-z0-9-]*(?: [A-Z][A-Za-z0-9-]*)*) $', 1), '') END AS raw_name,
  nullif(regexp_extract(text, {q(LICENSES)}, 1), '') AS lic, nullif(regexp_extract(text, {q(VERSION)}, 1), '') AS ver, urls[1] AS u1,
  CASE WHEN regexp_matches(text, {q(OWNING)}) THEN 0.9 ELSE 0.2 END::DOUBLE AS own, CASE WHEN regexp_matches(text, {q(USING)}) THEN 0.9 ELSE 0.2 END::DOUBLE AS used FROM urled),
mentions AS (SELECT *, 'C' || cand_no AS mention_id, artifact_yes >= 0.5 AS valid, CASE WHEN artifact_yes >= 0.5 AND lower(trim(raw_name)) NOT IN ({_keywords}) THEN raw_name END AS name,
  CASE WHEN artifact_yes >= 0.5 THEN lic END AS license, CASE WHEN artifact_yes >= 0.5 THEN ver END AS version, CASE WHEN artifact_yes >= 0.5 THEN u1 END AS url,
  CASE WHEN artifact_yes >= 0.5 THEN own END AS ownership_yes, CASE WHEN artifact_yes >= 0.5 THEN CASE WHEN own >= 0.5 THEN 'Yes' ELSE 'No' END END AS ownership,
  CASE WHEN artifact_yes >= 0.5 THEN used END AS reuse_yes, CASE WHEN artifact_yes >= 0.5 THEN CASE WHEN used >= 0.5 THEN 'Yes' ELSE 'No' END END AS reuse FROM asked)"""
ALL_MENTIONS = f"WITH {SENTS},{spans(ARTIFACT_LEXICON)},{NUMBERED},{MENTIONS}"
#: Acronym merges cannot happen here (no name without a space is in upper case twice), nor can citations join.
CLUSTERS = ALL_MENTIONS + """,
clustered AS (SELECT *, coalesce(name, 'Unnamed_' || (row_number() OVER (PARTITION BY doc_id, type, name IS NULL ORDER BY cand_no) - 1)) AS label,
  CASE WHEN name IS NULL THEN 'Unnamed' ELSE 'name_cluster_' || min(cand_no) OVER (PARTITION BY doc_id, type, name) END AS cluster,
  CASE WHEN name IS NULL THEN type || '_unnamed' ELSE type || '_cluster_' || min(cand_no) OVER (PARTITION BY doc_id, type, name) END AS display FROM mentions WHERE valid)"""


def lines_of(value: str, name: str) -> str:
    """A common table of ``value (pct%)`` lines for each artifact."""
    return f"""{name}_n AS (SELECT doc_id, type, cluster, label, {value} AS value, count(*) AS n, min(cand_no) AS at_ FROM clustered WHERE {value} IS NOT NULL GROUP BY ALL),
{name}_l AS (SELECT doc_id, type, cluster, label, string_agg(value || ' (' || (n / total * 100)::VARCHAR || '%)', chr(10) ORDER BY at_) AS {name} FROM
  (SELECT *, sum(n) OVER (PARTITION BY doc_id, type, cluster, label)::DOUBLE AS total FROM {name}_n) GROUP BY ALL)"""


REPORT = f"""{CLUSTERS},
base AS (SELECT doc_id, type, cluster, label, min(display) AS display, round(avg(artifact_yes), 6) AS score, arg_min(ownership, (par, sent, cand_no)) = 'Yes' AS o,
  round(coalesce(avg(ownership_yes) FILTER (ownership_yes >= 0.5), 0), 6) AS owned_score, round(coalesce(avg(reuse_yes) FILTER (reuse_yes >= 0.5), 0), 6) AS reused_score,
  count(*) AS k, count(*) FILTER (reuse = 'Yes') AS r FROM clustered GROUP BY doc_id, type, cluster, label),
{lines_of('license', 'licenses')},
{lines_of('version', 'versions')},
report AS (SELECT b.doc_id, b.type, b.cluster, b.label, display, score, CASE WHEN o THEN 'Yes' ELSE 'No' END AS owned, round(o::INT / k * 100, 6) AS owned_pct, owned_score,
  CASE WHEN r > 0 THEN 'Yes' ELSE 'No' END AS reused, round(r / k * 100, 6) AS reused_pct, reused_score, k AS mentions_count, coalesce(licenses, '') AS licenses, coalesce(versions, '') AS versions,
  '' AS urls, '' AS citations
  FROM base b LEFT JOIN licenses_l USING (doc_id, type, cluster, label) LEFT JOIN versions_l USING (doc_id, type, cluster, label))"""

CITED_MENTIONS = f"""WITH {SENTS}, marked AS (SELECT doc_id, par, sent, text || {q(MARKS)} AS text FROM sents WHERE contains(text, 'License')),{spans(ARTIFACT_LEXICON, 'marked')},{NUMBERED},{MENTIONS},
named AS (SELECT doc_id, type, name, cand_no, text FROM mentions WHERE valid AND name IS NOT NULL),
places AS (SELECT n.*, unnest(list_filter(range(0, length(text)), lambda i: text[i + 1:i + length(name)] = name)) AS own FROM named n),
marks(mark) AS (VALUES ('[12]'), ('(Smith 2019)')),
dists AS (SELECT p.*, mark, strpos(text, mark) - 1 AS at_, abs(strpos(text, mark) - 1 - own) AS dist FROM places p, marks),
best AS (SELECT * FROM dists QUALIFY row_number() OVER (PARTITION BY doc_id, type, name, cand_no ORDER BY dist, mark, at_) = 1),
others AS (SELECT DISTINCT doc_id, type, name AS other FROM named),
closest AS (SELECT doc_id, type, name, cand_no, mark AS citation FROM best b WHERE NOT EXISTS (SELECT 1 FROM others o, range(0, 2000) r(s)
  WHERE o.doc_id = b.doc_id AND o.type = b.type AND o.other != b.name AND s < length(b.text) AND b.text[s + 1:s + length(o.other)] = o.other
  AND NOT (s >= b.at_ AND s + length(o.other) <= b.at_ + length(b.mark)) AND abs(b.at_ - s) < b.dist)),
of_name AS (SELECT doc_id, type, name, arg_max(citation, (k, -f)) AS citation FROM (SELECT doc_id, type, name, citation, count(*) AS k, min(cand_no) AS f FROM closest GROUP BY ALL) GROUP BY ALL),
grps AS (SELECT doc_id, type, name, min(cand_no) AS grp, count(*) AS n FROM named GROUP BY ALL),
cedges AS (SELECT DISTINCT doc_id, type, a, grp AS b FROM (SELECT DISTINCT doc_id, type, citation, grp, min(grp) OVER (PARTITION BY doc_id, type, citation) AS a FROM grps JOIN of_name USING (doc_id, type, name)) WHERE a < grp)"""

_snip = """snips AS (SELECT regexp_extract(text, '^(\\S+)', 1) AS phrase, ['Dataset', 'Method', 'Dataset', 'Method'][doc_id % 4 + 1] AS type FROM documents WHERE doc_id % 3 != 0),
entries AS (SELECT DISTINCT phrase, type FROM snips WHERE phrase != '')"""
_url_texts = f"texts AS (SELECT page_id, 'See ' || url || {q(URL_TAIL)} || page_id::VARCHAR || '.' AS text FROM pages)"
_graded = "graded AS (SELECT doc_id, lang, length(text) < 600 AS p, quality = 0 AS g, text[1:3] AS a, upper(text[2:4]) AS b FROM documents JOIN labels USING (doc_id))"
_no_stop = " AND ".join(f"NOT list_contains(string_split_regex(lower(x), '\\s+'), {q(s)})" for s in CITATION_STOPWORDS)
_cited = f"cited AS (SELECT doc_id, text || {q(CITED)} AS text FROM documents)"


def _marks(pattern: str, stop: bool = False) -> str:
    found = f"regexp_extract_all(text, {q(pattern)})"
    return f"array_to_string(list_filter({found}, lambda x: {_no_stop}), '|')" if stop else f"array_to_string({found}, '|')"


ORACLES: dict[str, str] = {
    "lexicon_flatten": "SELECT DISTINCT trim(x) AS phrase FROM (SELECT unnest([p_brand, p_type, ' ' || p_name]) AS x FROM part) WHERE x != ''",
    "lexicon_merge": "SELECT phrase, string_agg(t, ',' ORDER BY t DESC) AS types FROM (SELECT DISTINCT trim(unnest([p_brand, p_type])) AS phrase, 'Method' AS t FROM part UNION SELECT DISTINCT trim(unnest([p_name, p_brand])), 'Dataset' FROM part) GROUP BY phrase",
    "lexicon_noise": "SELECT DISTINCT p_size::VARCHAR AS phrase FROM part WHERE p_size NOT IN (0, 2048, 7, 11)",
    "lexicon_from_tags": f"WITH {_snip} SELECT * FROM entries",
    "lexicon_new_entries": f"WITH {_snip} SELECT * FROM entries WHERE length(phrase) <= 6 AND NOT (phrase IN ('The', 'And') AND type = 'Dataset') AND NOT (phrase = 'And' AND type = 'Method')",
    "parse_answers": "SELECT * FROM (SELECT doc_id, unnest(['dataset', 'software', 'method']) AS type, unnest([regexp_extract(text, '^(\\S+)', 1), regexp_extract(text, '(\\S+)$', 1), 'x']) AS name FROM documents WHERE lang != 'es') WHERE name NOT IN ('|', '')",
    "lexicon_dynamic": "SELECT DISTINCT * FROM (SELECT doc_id, unnest([regexp_extract(text, '^(\\S+)', 1), regexp_extract(text, '(\\S+)$', 1)]) AS phrase, unnest(['Dataset', 'Method']) AS type FROM documents WHERE lang != 'es') WHERE phrase NOT IN ('|', '')",
    "paragraphs": f"WITH {PARS} SELECT doc_id, par::INT AS par, line AS text FROM pars",
    "sentences": f"WITH {SENTS} SELECT doc_id, par::INT AS par, sent::INT AS sent, text FROM sents",
    "snippet_offsets": f"WITH {SENTS}, o AS (SELECT *, (sum(length(text) + 1) OVER (PARTITION BY doc_id, par ORDER BY sent) - length(text) - 1)::INT AS s FROM sents) SELECT doc_id, par::INT AS par, sent::INT AS sent, s AS snippet_start, s + length(text)::INT AS snippet_end FROM o",
    "paragraph_offsets": f"WITH {SENTS}, p AS (SELECT doc_id, par, string_agg(text, ' ' ORDER BY sent) AS t FROM sents GROUP BY ALL), o AS (SELECT *, (sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY par) - length(t) - 1)::INT AS s FROM p) SELECT doc_id, par::INT AS par, s AS paragraph_start, s + length(t)::INT AS paragraph_end, md5(t) AS paragraph_md5 FROM o",
    "section_text": f"WITH {SENTS} SELECT doc_id, md5(string_agg(text, ' ' ORDER BY par, sent)) AS section_md5 FROM sents GROUP BY doc_id",
    "abstract_first": f"WITH {PARS}, t AS (SELECT doc_id, list(CASE WHEN length(line) % 5 = 0 THEN 'Abstract' ELSE line[1:8] END ORDER BY par) AS l FROM pars GROUP BY doc_id) SELECT doc_id, array_to_string(CASE WHEN l[-1] = 'Abstract' THEN list_concat(l[-1:], l[:-2]) ELSE l END, '|') AS titles FROM t",
    "contains_bool": f"WITH {SENTS} SELECT doc_id, count(*) FILTER (contains(lower(text), 'license')) AS n_license, count(*) FILTER (contains(lower(text), 'version')) AS n_version, count(*) FILTER (contains(lower(text), 'of th')) AS n_of FROM sents GROUP BY doc_id",
    "match_spans": f"WITH {SENTS},{spans(LEXICON)} SELECT doc_id, par::INT AS par, sent::INT AS sent, kind, phrase, st AS start, en AS \"end\" FROM found",
    "mention_counts": f"WITH {SENTS},{spans(LEXICON)} SELECT kind, phrase, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY ALL",
    "match_ids": f"WITH {SENTS},{spans(LEXICON)},{NUMBERED} SELECT doc_id, 'C' || cand_no AS mention_id, type, kind, phrase, par::INT AS par, sent::INT AS sent, st AS start FROM numbered",
    "annotated_mentions": f"WITH {SENTS},{spans(ARTIFACT_LEXICON)},{NUMBERED} SELECT doc_id, par::INT AS par, sent::INT AS sent, kind, phrase, st AS start, annotated FROM numbered",
    "paragraph_type_groups": f"WITH {SENTS},{spans(ARTIFACT_LEXICON)},{NUMBERED} SELECT doc_id, par::INT AS par, type, string_agg(annotated, '|' ORDER BY cand_no) AS annotated FROM numbered GROUP BY ALL",
    "candidate_counts": f"WITH {SENTS},{spans(LEXICON)} SELECT doc_id, par::INT AS par, kind, count(*) AS n FROM found GROUP BY ALL",
    "annotated_copies": f"WITH {SENTS}, at_ AS (SELECT *, unnest(list_filter(range(0, length(text)), lambda i: text[i + 1:i + 7] = 'License')) AS s FROM sents WHERE contains(text, 'License')) SELECT doc_id, par::INT AS par, sent::INT AS sent, (row_number() OVER (PARTITION BY doc_id, par, sent ORDER BY s) - 1)::INT AS i, text[1:s] || '<m>License</m>' || text[s + 8:] AS copy FROM at_",
    "citations": f"WITH {_cited} SELECT doc_id, {_marks('[\\[(][^\\]\\[)(]*?et al.*?(?:\\]|\\)|$)')} AS m0, {_marks('\\[\\s*\\d+\\s*\\]')} AS m1, {_marks('\\[\\s*[A-Z](?:[\\pL\\pM\\pN_]+\\s+(?:&\\s+)?)+\\d+\\s*(?:\\]|$)', True)} AS m1b, {_marks('\\(\\s*\\d+\\s*\\)')} AS m2, {_marks('\\(\\s*[A-Z](?:[\\pL\\pM\\pN_]+\\s+(?:&\\s+)?)+\\d+\\s*(?:\\)|$)', True)} AS m2b, true AS has FROM cited",
    "urls": f"WITH {_url_texts} SELECT page_id, array_to_string(list_filter({_url}, lambda u: {_no_noise}), '|') AS urls FROM texts",
    "code_host_urls": f"WITH {_url_texts} SELECT page_id, array_to_string(list_filter({_url}, lambda u: {' OR '.join(f'contains(u, {q(h)})' for h in CODE_HOSTS)}), '|') AS urls FROM texts",
    "url_filter": "SELECT DISTINCT page_id, part, NOT regexp_matches(part, '^(?:\\d+\\.?)+$') AND NOT regexp_matches(part, '^\\d+\\.\\w+$') AS is_url FROM (SELECT page_id, unnest(string_split_regex(url, '[/?]+')) AS part FROM pages)",
    "prompts": f"WITH {SENTS} SELECT doc_id, par::INT AS par, sent::INT AS sent, md5('### Snippet: ' || text || ' ### Question: ' || {q(QUESTIONS['name'].replace('{t}', 'dataset'))} || ' ### Answer:') AS prompt_md5 FROM sents",
    "section_titles": f"WITH {PARS} SELECT doc_id, par::INT AS par, par % 5 NOT IN (0, 1) AND NOT regexp_matches(lower(line), '\\b(related|background)\\b') AS valid FROM pars",
    "acronyms": f"WITH {PARS} SELECT doc_id, par::INT AS par, replace(upper(array_to_string(list_transform(list_filter(string_split_regex(trim(line), '\\s+'), lambda x: x != ''), lambda x: x[1]), '')), 'ẞ', 'SS') AS acronym FROM pars",
    "acronym_match": "WITH n AS (SELECT c_mktsegment || ' (' || upper(c_mktsegment[1:3]) || ') ' || c_name AS name FROM customer) SELECT name, regexp_matches(name, '(?:^|\\s|\\(|\\[)' || upper(name[1:3]) || '(?:$|\\s|\\)|\\])') AS contained, true AS is_acronym, upper(c_mktsegment_first(name)) = 'A(C' AS abbreviates FROM n".replace("upper(c_mktsegment_first(name))", "upper(name[1] || '(' || regexp_extract(name, '\\) (.)', 1))"),
    "distinct_in_order": "SELECT user_id, string_agg(event_type, '|' ORDER BY f) AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id",
    "choice_shares": "SELECT event_id, round((exp(value % 5) + exp(0.5)) / (exp(value % 5) + exp(0.5) + exp(1.0)), 6) AS p_yes FROM events",
    "fast_mode": f"WITH {SENTS},{spans(LEXICON)},{NUMBERED}, c AS (SELECT doc_id, par, '[' || type || '] : ' || phrase AS line, min(cand_no) AS f FROM numbered GROUP BY ALL), p AS (SELECT DISTINCT doc_id, par FROM sents), l AS (SELECT doc_id, par, string_agg(line, ' | ' ORDER BY f) AS candidates FROM c GROUP BY ALL) SELECT doc_id, par::INT AS par, coalesce(candidates, '') AS candidates, coalesce(replace(replace(candidates, '[', ''), ']', ''), 'N/A') AS results FROM p LEFT JOIN l USING (doc_id, par)",
    "paragraph_filter": f"WITH {SENTS},{spans(ARTIFACT_LEXICON)},{NUMBERED} SELECT doc_id, 'C' || cand_no AS mention_id, type, NOT ((par % 3 = 1 AND type = 'dataset') OR (par % 3 = 2 AND type = 'software')) AS skipped FROM numbered",
    "validity_cascade": f"{ALL_MENTIONS} SELECT doc_id, mention_id, artifact_yes, valid, name, license, version, url, ownership_yes, ownership, reuse_yes, reuse FROM mentions",
    "name_blanking": "SELECT p_partkey, ['N/A', 'N/A', 'BIOMRC', 'Corpus x', 'N/A'][p_partkey % 5 + 1] AS name FROM part",
    "new_thresholds": f"{ALL_MENTIONS} SELECT doc_id, mention_id, artifact_yes, CASE WHEN ownership_yes >= 0.5 THEN 'Yes' ELSE 'No' END AS ownership, CASE WHEN reuse_yes >= 0.8 THEN 'Yes' ELSE 'No' END AS reuse FROM mentions WHERE artifact_yes >= 0.6",
    "name_groups": f"{ALL_MENTIONS} SELECT doc_id, type, name, min(cand_no) AS first, count(*) AS n FROM mentions WHERE valid AND name IS NOT NULL GROUP BY ALL",
    "name_pairs": f"{ALL_MENTIONS}, g AS (SELECT doc_id, type, name, min(cand_no) AS f FROM mentions WHERE valid AND name IS NOT NULL GROUP BY ALL) SELECT a.doc_id, a.type, a.name AS name_a, b.name AS name_b FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.type = b.type AND (a.f, a.name) < (b.f, b.name)",
    "closest_citations": f"{CITED_MENTIONS} SELECT * FROM closest",
    "citation_of_name": f"{CITED_MENTIONS} SELECT * FROM of_name",
    "citation_edges": f"{CITED_MENTIONS} SELECT * FROM cedges",
    "merged_groups": f"{CITED_MENTIONS} SELECT g.doc_id, g.type, g.name, coalesce(min(e.a), g.grp) AS grp FROM grps g LEFT JOIN cedges e ON g.doc_id = e.doc_id AND g.type = e.type AND g.grp = e.b GROUP BY g.doc_id, g.type, g.name, g.grp",
    "acronym_edges": "WITH l AS (SELECT c_nationkey::BIGINT AS doc_id, c_mktsegment || ' Data ' || c_custkey AS name, c_custkey AS grp FROM customer), s AS (SELECT c_nationkey::BIGINT AS doc_id, c_mktsegment[1:9] AS short, min(c_custkey) + 1000000000 AS grp FROM customer GROUP BY ALL) SELECT DISTINCT l.doc_id, 'dataset' AS type, l.grp AS a, s.grp AS b FROM l JOIN s ON l.doc_id = s.doc_id AND starts_with(l.name, s.short || ' ')",
    "components": "WITH c AS (SELECT o_custkey, min(-1 - o_orderkey) AS component FROM orders GROUP BY o_custkey) SELECT o_custkey AS node, component FROM c UNION ALL SELECT -1 - o_orderkey, component FROM orders JOIN c USING (o_custkey)",
    "clusters": f"{CLUSTERS} SELECT doc_id, mention_id, type, label, cluster FROM clustered",
    "artifact_report": f"{REPORT} SELECT * FROM report",
    "simple_lists": f"{REPORT} SELECT doc_id, type, label, regexp_replace(licenses, ' \\([^ \\n]*%\\)', '', 'g') AS licenses, regexp_replace(versions, ' \\([^ \\n]*%\\)', '', 'g') AS versions FROM report",
    "license_shares": f"{CLUSTERS} SELECT type, label, license AS value, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY type, label), 6) AS pct FROM clustered WHERE license IS NOT NULL GROUP BY type, label, license",
    "url_shares": f"WITH {_url_texts}, u AS (SELECT unnest(list_filter({_url}, lambda u: {_no_noise})) AS u FROM texts), h AS (SELECT regexp_extract(u, '^(?:https?://)?([^/?#:]+)', 1) AS value, regexp_extract(u, '^(https?)', 1) AS scheme FROM u) SELECT scheme, value, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY scheme), 6) AS pct FROM h GROUP BY scheme, value",
    "mentions_table": f"{CLUSTERS} SELECT doc_id, mention_id, display, label AS artifact, kind, artifact_yes, CASE WHEN ownership_yes >= 0.5 THEN 'Yes' ELSE 'No' END AS owned, ownership_yes, CASE WHEN reuse_yes >= 0.5 THEN 'Yes' ELSE 'No' END AS reused, reuse_yes, coalesce(license, '') AS license, coalesce(version, '') AS version, array_to_string(urls, chr(10)) AS urls, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\(\\s*\\d+\\s*\\)'))), chr(10)) AS citations, '' AS title, 0 AS sec, par::INT AS par, sent::INT AS sent, phrase AS trigger, annotated FROM clustered",
    "citations_table": "SELECT o_custkey AS doc_id, o_orderkey::INT AS number, 'b' || o_orderkey AS id, '' AS doi, o_orderstatus AS title, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus || ' ' ELSE '' END || o_orderpriority END AS authors FROM orders WHERE o_orderkey % 5 > 0",
    "citances_table": "SELECT l_orderkey AS doc_id, l_linenumber AS sec_idx, CASE l_linenumber WHEN 1 THEN '#b' || l_partkey WHEN 2 THEN '#fig_' || l_suppkey WHEN 3 THEN 'other' ELSE '' END AS target, l_returnflag AS type, '' AS text, 'Skipped' AS intent, CASE l_linenumber WHEN 2 THEN '#fig' ELSE '' END AS key_name, CASE l_linenumber WHEN 1 THEN l_partkey WHEN 2 THEN l_suppkey ELSE -1 END::INT AS key_number FROM lineitem",
    "eval_binary": f"WITH {_graded}, c AS (SELECT lang, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn FROM graded GROUP BY lang) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c",
    "eval_match": f"WITH {_graded}, m AS (SELECT a, CASE WHEN doc_id % 2 = 0 THEN lower(a) ELSE b END AS b FROM graded) SELECT count(*) AS n, round(avg((lower(a) = lower(b))::INT), 6) AS exact, round(avg((contains(lower(a), lower(b)) OR contains(lower(b), lower(a)))::INT), 6) AS lenient FROM m",
    "eval_errors": f"WITH {_graded} SELECT doc_id AS item, a AS pred, b AS gold FROM graded WHERE lower(a) != lower(b)",
    "eval_offsets": f"WITH {SENTS},{spans(ARTIFACT_LEXICON)} SELECT doc_id, par::INT AS par, sent::INT AS sent, kind, st AS start, en AS \"end\", md5(text) AS text_md5 FROM found",
    "top_terms": "WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\\pL+')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL) SELECT lang, term, n, (row_number() OVER (PARTITION BY lang ORDER BY n DESC, term))::INT AS rank FROM c QUALIFY rank <= 10",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL",
}
