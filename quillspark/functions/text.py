"""String, regex and span functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.fixed import CITATION_PATTERNS, CITATION_STOPWORDS, CODE_HOSTS, MISSING, QUESTIONS, URL_NOISE

Col = Column | str

#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Dr", "Prof", "Fig", "Figs", "Eq", "Sec", "al", "e.g", "i.e", "vs", "cf", "etc", "approx")
HOLD, CUT = "␟", "␞"

#: A URL with a scheme, or a host name with a known ending.
URL_PATTERN = r"(?:https?://[^\s<>\"']+|(?:[A-Za-z0-9-]+\.)+(?:com|org|net|edu|gov|io|eu|uk|de|fr|es|it|ai|info)(?:/[^\s<>\"']*)?)"


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Col) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def simple_lower(x: Col) -> Column:
    """Lower case by one character for each, wherever it stands: no final sigma, no combining dot."""
    return F.lower(F.translate(_c(x), "İΣ", "iσ"))


#: Letters whose capital form is several characters, but that have a single one too.
_MANY = "ß" + "".join(chr(start + i) for start in (0x1F80, 0x1F90, 0x1FA0) for i in range(8)) + "ᾳῃῳ"
_ONE = "ẞ" + "".join(chr(start + i) for start in (0x1F88, 0x1F98, 0x1FA8) for i in range(8)) + "ᾼῌῼ"


def simple_upper(x: Col) -> Column:
    """Upper case by one character for each; one whose capital form is several, and no single one, stays."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, _MANY, _ONE))
    return F.array_join(F.transform(F.split(_c(x), ""), one), "")


def split_sentences(paragraph: Col) -> Column:
    """Sentences end after . ! or ? before white space, but not after an abbreviation; blank ones go."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    held = F.regexp_replace(_c(paragraph), rf"\b({short})\.\s+", f"$1.{HOLD}")
    parts = F.split(F.regexp_replace(held, r"([.!?]+)\s+", f"$1{CUT}"), CUT, -1)
    return F.filter(F.transform(parts, lambda s: F.replace(s, F.lit(HOLD), F.lit(" "))), lambda s: F.trim(s) != "")


def find_citations(text: Col) -> Column:
    """A struct of five arrays of citation marks: with et al., numbers in brackets, names in brackets, and the same
    two in parentheses. Marks of names with a stopword among their white-space tokens are left out."""

    def marks(name: str) -> Column:
        found = F.regexp_extract_all(_c(text), F.lit("(?U)" + CITATION_PATTERNS[name]), F.lit(0))
        if name.endswith("b"):
            found = F.filter(found, lambda m: ~F.exists(F.split(m, r"(?U)\s+"), lambda t: F.lower(strip(t)).isin(*CITATION_STOPWORDS)))
        return found.alias(name)

    return F.struct(*map(marks, CITATION_PATTERNS))


def all_citations(citations: Col) -> Column:
    c = _c(citations)
    return F.flatten(F.array(*(c[name] for name in CITATION_PATTERNS)))


def has_citations(text: Col) -> Column:
    return _c(text).contains("et al") | _c(text).rlike(r"\[\s*\d+") | _c(text).rlike("(?U)" + r"\(\s*\d+\s*(?!\s*(?:\w|[^\w,\-\)])|\s*,\d+(?:[^\w,\-\)]))")


def is_url(url: Col) -> Column:
    """Not only dotted numbers, and not a number with an ending."""
    return ~_c(url).rlike(r"^(?:\d+\.?)+$") & ~_c(url).rlike(r"^\d+\.\w+$")


def find_urls(text: Col, code_hosts_only: bool = False, filter_noise: bool = True) -> Column:
    """URLs of a text, without one trailing sign. Only those on code hosts, or else without noise, or all."""
    found = F.regexp_extract_all(_c(text), F.lit(URL_PATTERN), F.lit(0))
    found = F.transform(found, lambda u: F.regexp_replace(u, r"[.(){}\[\]<>,:!@$%^&*;]$", ""))
    if code_hosts_only:
        return F.filter(found, is_code_url)
    if filter_noise:
        return F.filter(found, lambda u: is_url(u) & ~_any(u.startswith(x) for x in URL_NOISE) & ~u.endswith(".et"))
    return found


def _any(conditions) -> Column:
    total = F.lit(False)
    for x in conditions:
        total = total | x
    return total


def is_code_url(url: Col) -> Column:
    return _any(_c(url).contains(h) for h in CODE_HOSTS)


def make_prompt(context: Col, question: Col) -> Column:
    return F.concat(F.lit("### Snippet: "), _c(context), F.lit(" ### Question: "), _c(question), F.lit(" ### Answer:"))


def question(name: str, kind_type: Col) -> Column:
    return F.replace(F.lit(QUESTIONS[name]), F.lit("{t}"), _c(kind_type))


def is_valid_section_title(title: Col) -> Column:
    t = _c(title)
    return t.isNull() | (t == "") | ~F.lower(t).rlike(r"(?U)\b(related|background)\b")


def annotate(text: Col, start: Col, end: Col) -> Column:
    """<m> and </m> around a half-open span of code points."""
    t, s, e = _c(text), _c(start), _c(end)
    return F.concat(F.substr(t, F.lit(1), s), F.lit("<m>"), F.substr(t, s + 1, e - s), F.lit("</m>"), F.substr(t, e + 1))


def quoted(literal: Col) -> Column:
    """A regular expression that matches the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(_c(literal), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def starts_of(text: Col, pattern: Col, size: Col) -> Column:
    """Starts of all matches, left to right without overlap, of a pattern whose matches are ``size`` long."""
    parts = F.split(_c(text), _c(pattern), -1)
    count = F.size(parts) - 1

    def start(k):
        before = F.aggregate(F.slice(parts, 1, k + 1), F.lit(0), lambda a, x: a + F.length(x))
        return before + k * _c(size)

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), start)).otherwise(F.array().cast("array<int>"))


def annotated_copies(text: Col, phrase: Col) -> Column:
    """One annotated copy of the text for each occurrence of the phrase."""
    size = F.length(_c(phrase))
    return F.transform(starts_of(text, quoted(phrase), size), lambda s: annotate(text, s, s + size))


def acronym(name: Col) -> Column:
    """First characters of the white-space tokens, in upper case."""
    tokens = F.filter(F.split(strip(name), r"(?U)\s+"), lambda t: t != "")
    return F.upper(F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), ""))


def contains_acronym(name: Col, short: Col) -> Column:
    """The acronym as a whole token, possibly in brackets or parentheses."""
    pattern = F.concat(F.lit(r"(?:^|\s|\(|\[)"), quoted(short), F.lit(r"(?:$|\s|\)|\])"))
    return F.regexp_like(_c(name), pattern)


def is_acronym(name: Col) -> Column:
    return (_c(name) == F.upper(_c(name))) & ~_c(name).rlike(r"(?U)\W")


def parse_answer(answer: Col) -> Column:
    """``type : name | type : name`` as an array of (type, name); parts without exactly one colon, without a name or
    equal to N/A are left out."""
    parts = F.transform(F.split(F.coalesce(_c(answer), F.lit("")), r"\|"), strip)
    pairs = F.filter(parts, lambda p: (p != MISSING) & (F.size(F.split(p, ":", -1)) == 2))
    named = F.transform(pairs, lambda p: F.struct(strip(F.get(F.split(p, ":", -1), F.lit(0))).alias("type"), strip(F.get(F.split(p, ":", -1), F.lit(1))).alias("name")))
    return F.filter(named, lambda x: x["name"] != "")


def answer_types(answer: Col) -> Column:
    """The types an answer names; none for N/A."""
    parts = F.split(_c(answer), r"\|")
    named = F.array_distinct(F.transform(parts, lambda p: strip(F.get(F.split(p, ":", -1), F.lit(0)))))
    return F.when(_c(answer) == MISSING, F.array().cast("array<string>")).otherwise(named)


def or_missing(x: Col) -> Column:
    return F.coalesce(_c(x), F.lit(MISSING))


def cluster_display_name(kind_type: Col, cluster: Col) -> Column:
    suffix = F.regexp_replace(_c(cluster), "^[^_]*_", "")
    return F.when(_c(cluster) == "Unnamed", F.concat(_c(kind_type), F.lit("_unnamed"))).otherwise(F.concat(_c(kind_type), F.lit("_"), suffix))


def relative_probabilities(scores: Col, choices: list[str]) -> Column:
    """Weights of choices from a list of token-to-weight maps: sums over the places, divided by their total if it is
    positive. Returns a map of choice to share."""

    def weight(choice: str) -> Column:
        return F.aggregate(_c(scores), F.lit(0.0), lambda a, m: a + F.coalesce(F.try_element_at(m, F.lit(choice)), F.lit(0.0)))

    weights = [weight(c) for c in choices]
    total = sum(weights[1:], weights[0])
    shares = (x for c, w in zip(choices, weights, strict=True) for x in (F.lit(c), F.when(total > 0, w / total).otherwise(w)))
    return F.create_map(*shares)


def classify_logits(logits: Col, choices: list[str], top_k: int = 500) -> Column:
    """Softmax over the choices: of each place's (token, logit) pairs the top k by logit count, equal tokens add up."""

    def weights(pairs):
        top = F.slice(F.array_sort(pairs, lambda a, b: F.when(a["logit"] > b["logit"], -1).when(a["logit"] < b["logit"], 1).otherwise(0)), 1, top_k)
        return F.map_from_entries(
            F.transform(F.array_distinct(F.transform(top, lambda p: p["token"])), lambda t: F.struct(t, F.aggregate(F.filter(top, lambda p: p["token"] == t), F.lit(0.0), lambda a, p: a + F.exp(p["logit"]))))
        )

    return relative_probabilities(F.transform(_c(logits), weights), choices)


def multilabel_logits(logits_of: Col, top_k: int = 500) -> Column:
    """Of a map from choice to logits, each choice's own probability of Yes."""
    return F.transform_values(_c(logits_of), lambda _, v: F.element_at(classify_logits(v, ["Yes", "No"], top_k), "Yes"))


def common(a: Col, b: Col) -> Column:
    return F.array_intersect(_c(a), _c(b))


def united(a: Col, b: Col) -> Column:
    return F.array_union(_c(a), _c(b))


def normalize_threshold(threshold: float, n: int) -> float:
    """Falls with the number of choices over two."""
    return threshold if n <= 2 else 2 * threshold / n
