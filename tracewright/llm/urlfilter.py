"""URL filters (operator 5).

Method: pattern rules indexed by their rarest literal token. A rule's pattern
is turned into a regular expression and the list of tokens (runs of letters and
digits) that any URL it matches must have whole; how often the rules' tokens
occur is counted over all URLs, and a rule is filed under its rarest. A URL's
tokens fetch the rules filed under them, and only those are run.

Patterns: `||` begins at a host name or one of its parts, `|` is an end of the
URL, `*` is anything, `^` is a separator or the end; the rest stands for itself.
A rule whose pattern begins with `@@` is an exception: it lets a URL pass that
others block. URLs are compared in lower case. Rules without a token of their
own are tried on every URL. At most `slice_rules` rules go to a task at once;
more take further passes.

The rules given here are an example; rules_of() reads a list in the usual format.

Edge cases: a null or empty URL matches nothing (action none); a null page_id
and repeated rows pass through, each by itself; page_id may be of any type; of
tokens that tie for the rarest the first counts, which changes no result; a very
long URL is matched whole; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, need

SLICE_RULES = 20_000
RULES = (
    "||ads.", "||adserver.", "||ads-track.example.com^", "-track.example.", "/adclick^", "/banners/*.gif|", "||doubleclick.*^", "/track/pixel^", "?utm_source=spam^", "||spam-farm.example.org^",
    "spam-*.example.", "||casino-win.example.net^", "-casino.", "/casino/", "/slots/*bonus", "||free-bets.example.net^", "/bets/live^", "||cheap-pills.example.net^", "-pills.", "/pills/buy^", "||adult-x.example.com^", "||xxx.",
    "/porn/", "/warez/", "/torrent/*.torrent|", "/login^", "/cart^", "/checkout^", "/wp-admin/", "/cgi-bin/", ".exe|", ".zip|", "/tag/*/page/", "?sessionid=", "&phpsessid=", "/print/*.html|", "||mirror.*.example.com^",
    "|http://*.example.net/*/999^", "/en/13*.html|", "?replytocom=", "/calendar/*/2038/",
    "@@||free-bets.example.net^en^", "@@||ads.example.com/about^", "@@||blog.casino-win.example.net^*.html|", "@@/login/help^", "@@||adult-x.example.com/*?page=2&ref=",
)
_HOST = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?"
_SEPARATOR = r"([^a-z0-9_.%-]|$)"


@dataclass(frozen=True)
class Rule:
    pattern: str
    allow: bool
    regex: str
    tokens: tuple[str, ...]


def parse(pattern: str) -> Rule:
    text = pattern.lower()
    allow = text.startswith("@@")
    text = text[2:] if allow else text
    begins = "host" if text.startswith("||") else "start" if text.startswith("|") else ""
    body = text.lstrip("|") if begins else text
    ends = body.endswith("|")
    body = body[:-1] if ends else body
    regex = {"host": _HOST, "start": "^", "": ""}[begins]
    for c in body:
        regex += ".*" if c == "*" else _SEPARATOR if c == "^" else re.sub(r"([^a-z0-9_/:=&%-])", r"\\\1", c)
    # A run is a whole token if what is beside it can't be a letter or digit.
    tokens = []
    for m in re.finditer(r"[a-z0-9]+", body):
        left = body[m.start() - 1] != "*" if m.start() else bool(begins)
        right = body[m.end()] != "*" if m.end() < len(body) else ends
        if left and right:
            tokens.append(m.group())
    return Rule(pattern, allow, regex + ("$" if ends else ""), tuple(dict.fromkeys(tokens)))


def rules_of(text: str) -> tuple[str, ...]:
    """The patterns of a rule list in the usual format: a line each; comments
    (`!`, `[`), rules for page elements (`##`, `#@#`, `#?#`), regular expressions
    (`/.../`) and rules that hold for some requests only (`$option`) are left
    out, as a URL alone doesn't decide them; repeated ones count once."""
    out = []
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] in "![" or re.search(r"#[@?]?#", line) or re.search(r"\$[a-z~][a-z0-9~,=|._-]*$", line) or re.fullmatch(r"(@@)?/.*/", line) and re.search(r"[\\\[(+?{]", line):
            continue
        out.append(line)
    return tuple(dict.fromkeys(out))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many of all rows' URLs each token of the rules occurs. urls: (u)."""
    wanted = sorted({t for r in rules for t in r.tokens})
    spark = urls.sparkSession
    own = spark.createDataFrame([(t,) for t in wanted], "token string")
    seen = urls.select(F.explode(F.array_distinct(F.split("u", "[^a-z0-9]+"))).alias("token"))
    # As many rows as the rules have tokens: Spark broadcasts them below its own limit, else shuffles.
    return {r["token"]: r["count"] for r in seen.join(own, "token").groupBy("token").count().collect()}


def index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token (the first of equals), and those without any."""
    by: dict[str, list[int]] = {}
    rest = []
    for i, r in enumerate(rules):
        if r.tokens:
            by.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            rest.append(i)
    return by, rest


def _matcher(rules: list[Rule], by: dict[str, list[int]], rest: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.regex) for r in rules]
        tokens = re.compile("[a-z0-9]+")
        for batch in batches:
            found = batch.column(2).to_pylist()
            tried = batch.column(3).to_pylist()
            for row, u in enumerate(batch.column(1).to_pylist()):
                if not u:
                    continue
                candidates = {i for t in {*tokens.findall(u)} if t in by for i in by[t]} | {*rest}
                found[row] = found[row] + [rules[i].pattern for i in candidates if compiled[i].search(u)]
                tried[row] += len(candidates)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string())), pa.array(tried, pa.int64())], names=["page_id", "u", "found", "tried"])

    return run


def apply(df: DataFrame, patterns: tuple[str, ...] = RULES, slice_rules: int = SLICE_RULES) -> DataFrame:
    """(page_id, rules, n_rules, action) of every row; rules: the patterns that
    match, in order, joined by a space; action: block, allow or none."""
    rules = [parse(p) for p in dict.fromkeys(patterns)]
    urls = need(df, "page_id", "url").select("page_id", F.lower("url").alias("u"))
    counts = token_counts(urls.select("u").filter("u is not null"), rules)
    out = urls.select("page_id", "u", F.array().cast("array<string>").alias("found"), F.lit(0).cast("long").alias("tried"))
    schema = f"page_id {kind(df, 'page_id')}, u string, found array<string>, tried long"
    for a in range(0, len(rules), slice_rules):
        own = rules[a : a + slice_rules]
        out = out.mapInArrow(_matcher(own, *index(own, counts)), schema)
    passes = F.exists("found", lambda p: F.startswith(p, F.lit("@@")))
    action = F.when(F.size("found") == 0, "none").when(passes, "allow").otherwise("block")
    return out.select("page_id", F.array_join(F.sort_array("found"), " ").alias("rules"), F.size("found").cast("long").alias("n_rules"), action.alias("action"))


def oracle_sql(patterns: tuple[str, ...] = RULES) -> str:
    """Every rule tried on every URL."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    rules = ", ".join(f"({quoted(r.pattern)}, {quoted(r.regex)})" for r in map(parse, dict.fromkeys(patterns)))
    return f"""
WITH rules(pattern, regex) AS (VALUES {rules}), hits AS (
    SELECT page_id, url, string_agg(pattern, ' ' ORDER BY pattern) AS rules, count(*) AS n_rules, bool_or(pattern LIKE '@@%') AS passes
    FROM (SELECT DISTINCT page_id, url FROM pages) JOIN rules ON regexp_matches(lower(url), regex) GROUP BY page_id, url
)
SELECT p.page_id, coalesce(h.rules, '') AS rules, coalesce(h.n_rules, 0) AS n_rules,
       CASE WHEN h.n_rules IS NULL THEN 'none' WHEN h.passes THEN 'allow' ELSE 'block' END AS action
FROM pages AS p LEFT JOIN hits AS h ON p.page_id = h.page_id AND p.url = h.url"""
