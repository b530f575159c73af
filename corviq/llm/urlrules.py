"""URL filter rules, indexed by their rarest literal token.

Rules are written as patterns over a url's host and path (scheme, query and fragment aren't looked at), without regard
to case:

* ``*`` stands for any characters, ``^`` for a separator (any but letters, digits, ``_ - . %``) or the end;
* ``||`` in front: the pattern begins at the host or after a dot of it; ``|`` in front: at the host's first character;
  ``|`` at the end: the pattern ends where the path does; else it may stand anywhere;
* ``/.../``: a regular expression; ``@@`` in front of any of these: allow what it fits; ``!`` in front: no rule.

Lists of any length may come from a text file or a table: short ones travel with the tasks, long ones are joined with
the urls by token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corviq.llm.common import materialize, with_fields

TOKEN = re.compile(r"[a-z0-9]+")
IN_TASKS = 100_000  # rules that travel with the tasks; longer lists are joined by token


@dataclass(frozen=True)
class Rule:
    """A rule: what it says, a regular expression over ``host + path``, and tokens that each fitting url must hold.

    ``length`` decides between host rules that fit: the longest wins, ties by name. ``own``: a rule of the method's
    list, which decides where no host rule fits; there, a rule that allows wins.
    """

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    length: int
    own: bool = False


def host_rule(rule: str, verdict: str) -> Rule:
    """``example.net/en/``: the host and all its subdomains, where the path starts with the rule's."""
    host, slash, path = rule.partition("/")
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    # the last token of a path may go on in the url ("/de" fits "/dem"); only tokens that must end there count
    whole = host.lower() + "/" + path[: path.rfind("/") + 1].lower()
    return Rule(rule, verdict, regex, tuple(dict.fromkeys(TOKEN.findall(whole))), len(rule))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A host label, or a part of one between hyphens, that is ``word`` (itself perhaps with hyphens)."""
    return Rule(word, verdict, rf"^(?:[^/]*[.\-])?{re.escape(word)}(?:[.\-:/]|$)", tuple(TOKEN.findall(word)), 0, own=True)


def pattern_rule(text: str) -> Rule | None:
    """A rule in the documented form; None for comments and empty lines."""
    text = text.strip()
    if not text or text[0] == "!":
        return None
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    if len(body) > 2 and body[0] == body[-1] == "/":
        re.compile(body[1:-1])  # a wrong expression fails now
        return Rule(text, verdict, f"(?i)^.*?(?:{body[1:-1]})", (), 0, own=True)
    host, start = body.startswith("||"), body.startswith("|")
    body = body[2:] if host else body[1:] if start else body
    end = body.endswith("|")
    body = body[:-1] if end else body
    regex = "".join(".*" if c == "*" else "(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body)
    lead = r"^(?:[^/]*\.)?" if host else "^" if start else "^.*?"
    # a token counts if the pattern shows both its ends
    edged = ("." if host or start else "a") + body.lower() + ("." if end else "a")
    whole = [m[0] for m in TOKEN.finditer(edged) if 0 < m.start() and m.end() < len(edged) and "*" not in (edged[m.start() - 1], edged[m.end()])]
    return Rule(text, verdict, f"(?i){lead}{regex}{'$' if end else ''}", tuple(dict.fromkeys(whole)), 0, own=True)


def read_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, verdict, regex, tokens, length, own) of a table or text file with a rule a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rule_batch([r for t in batch.column(0).to_pylist() if t is not None and (r := pattern_rule(t))])

    return lines.select(F.col(column).cast("string")).mapInArrow(run, RULE)


RULE = "name string, verdict string, regex string, tokens array<string>, length int, own boolean"


def _rule_batch(rules: list[Rule]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.bool_())
    names = [f.split()[0] for f in RULE.split(", ")]
    columns = [[list(r.tokens) if n == "tokens" else getattr(r, n) for r in rules] for n in names]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


HOST_RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
BLOCKED_WORDS = (
    "casino", "poker", "slots", "betting", "gambling", "jackpot", "porn", "porno", "xxx", "sex", "escort", "hentai", "camgirls", "warez",
    "adult", "spam", "ads", "bets", "pills", "keygen", "torrent", "phishing", "malware", "viagra", "cialis", "adserver", "doubleclick", "payday-loans", "free-pills", "cheap-pills",
)
WORD_RULES = tuple(word_rule(w) for w in BLOCKED_WORDS)
PATTERNS = (
    "||track.*^", "||tracker.*^", "||adservice.*^", "||pixel.*^click", "/adserver/*", "/banner-ads/", "/popunder^", "^affiliate-redirect^", "/phishing-kit/", "/free-casino-bonus", "/xxx/*.html|",
    "@@||docs.*^adserver^", "@@||health.*^adult^",
)
PATTERN_RULES = tuple(pattern_rule(p) for p in PATTERNS)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as documented at :func:`host_and_path`, of one url."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: then up to ``?`` or ``#``.

    Both are empty if the url is null or has no ``://``.
    """
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleIndex:
    """Rules under their rarest token; only rules whose token a url holds run their regular expression."""

    def __init__(self, rules: tuple[Rule, ...], seen: dict[str, int]):
        self.by: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            entry = (rule, re.compile(rule.regex, re.DOTALL))
            if rule.tokens:
                self.by.setdefault(min(rule.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(the winning host rule or None, verdict)."""
        target = host + path
        fits = [
            rule
            for token in set(TOKEN.findall(target.lower())) & self.by.keys() | {""}
            for rule, pattern in (self.by[token] if token else self.always)
            if pattern.match(target)
        ]
        return decide([(r.length, r.name, r.verdict) for r in fits if not r.own], {r.verdict for r in fits if r.own})


def decide(hosts: list[tuple[int, str, str]], own: set[str]) -> tuple[str | None, str]:
    """The longest host rule (ties by name), else the method's rules: block, unless one of them allows."""
    if hosts:
        _, name, verdict = max(hosts)
        return name, verdict
    return None, "block" if own == {"block"} else "allow"


def _judged(batches: Iterator[pa.RecordBatch], index: RuleIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        host, path = (batch.column(names.index(n)).to_pylist() for n in ("host", "path"))
        found = [index.judge(h, p) for h, p in zip(host, path, strict=True)]
        yield pa.record_batch([*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], [*names, "rule", "verdict"])


def _tokens_of(target: Column) -> Column:
    return F.array_distinct(F.split(F.lower(target), "[^a-z0-9]+"))


def filter_urls(pages: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple[Rule, ...] | DataFrame = HOST_RULES + WORD_RULES + PATTERN_RULES) -> DataFrame:
    """The columns ``keep`` with host, path, rule (null if no host rule fits) and verdict (allow or block).

    ``rules``: a list, or a table as of :func:`read_rules`. How rare a token is, is counted over all urls. Up to
    ``IN_TASKS`` rules travel with the tasks, and urls are never shuffled, so a host that holds a third of all rows costs
    nothing. Longer lists are joined: distinct urls' tokens with the rules under their rarest token; only rules without
    any token travel then. Null urls and urls without ``://`` have empty host and path and are allowed; very long ones
    are judged whole. Repeated rows are judged each by itself. An empty table gives an empty result.
    """
    host, path = host_and_path(url_col)
    split = pages.select(*keep, host.alias("host"), path.alias("path"))
    schema = with_fields(split.schema, ("rule", "string"), ("verdict", "string"))
    if isinstance(rules, DataFrame):
        few = rules.limit(IN_TASKS + 1).collect()
        if len(few) > IN_TASKS:
            return _joined(split, rules)
        rules = tuple(Rule(r["name"], r["verdict"], r["regex"], tuple(r["tokens"]), r["length"], r["own"]) for r in few)
    elif len(rules) > IN_TASKS:
        return _joined(split, pages.sparkSession.createDataFrame([(r.name, r.verdict, r.regex, list(r.tokens), r.length, r.own) for r in rules], RULE))
    tokens = sorted({t for r in rules for t in r.tokens})
    seen = {}
    if tokens:
        known = pages.sparkSession.createDataFrame([(t,) for t in tokens], "t string")  # a few per rule
        urls = split.select(F.explode(_tokens_of(F.concat("host", "path"))).alias("t"))
        seen = {r["t"]: r["count"] for r in urls.join(F.broadcast(known), "t").groupBy("t").count().collect()}
    index = RuleIndex(rules, seen)
    return split.mapInArrow(lambda it: _judged(it, index), schema)


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compiled = lru_cache(1 << 16)(lambda regex: re.compile(regex, re.DOTALL))
    for batch in batches:
        names = batch.schema.names
        regex, host, path = (batch.column(names.index(n)).to_pylist() for n in ("regex", "host", "path"))
        fits = [bool(compiled(r).match(h + p)) for r, h, p in zip(regex, host, path, strict=True)]
        kept = batch.filter(pa.array(fits))
        yield kept.select(["host", "path", "name", "verdict", "length", "own"])


def _joined(split: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdicts by a join of the urls' tokens with the rules' rarest ones; only what a join brings together is tested."""
    rules = materialize(rules)
    urls = materialize(split.select("host", "path").distinct())
    tokens = urls.select("host", "path", F.explode(_tokens_of(F.concat("host", "path"))).alias("t"))
    counts = tokens.groupBy("t").count()
    ruled = rules.withColumn("r", F.struct(*rules.columns)).select("r", F.explode_outer("tokens").alias("t"))
    rarest = ruled.join(counts, "t", "left").groupBy("r").agg(F.min_by("t", F.struct(F.coalesce("count", F.lit(0)), "t")).alias("t")).select("r.*", "t")
    rarest = materialize(rarest.drop("tokens"))
    found = tokens.join(rarest, "t").select("regex", "host", "path", "name", "verdict", "length", "own")
    loose = [Rule(r["name"], r["verdict"], r["regex"], (), r["length"], r["own"]) for r in rarest.where("t is null").collect()]
    schema = "host string, path string, name string, verdict string, length int, own boolean"
    fits = found.mapInArrow(_tested, schema)
    if loose:
        fits = fits.union(urls.select("host", "path").mapInArrow(lambda it: _loose(it, loose), schema))
    hosts = F.struct("length", "name", "verdict")
    per = fits.groupBy("host", "path").agg(
        F.max(F.when(~F.col("own"), hosts)).alias("best"), F.max(F.col("own") & (F.col("verdict") == "block")).alias("blocks"), F.max(F.col("own") & (F.col("verdict") == "allow")).alias("allows")
    )
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("blocks") & ~F.col("allows"), "block").otherwise("allow"))
    per = per.select("host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"))
    return split.join(per, ["host", "path"], "left").select(*split.columns, "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def _loose(batches: Iterator[pa.RecordBatch], rules: list[Rule]) -> Iterator[pa.RecordBatch]:
    patterns = [(r, re.compile(r.regex, re.DOTALL)) for r in rules]
    for batch in batches:
        rows = [(h, p, r) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r, x in patterns if x.match(h + p)]
        columns = [[h for h, _, _ in rows], [p for _, p, _ in rows], *([getattr(r, n) for _, _, r in rows] for n in ("name", "verdict", "length", "own"))]
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "path", "name", "verdict", "length", "own"])
