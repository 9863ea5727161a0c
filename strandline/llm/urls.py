"""URL filters: rules found by their rarest literal token.

A rule is a host with a path prefix (``example.org/es/``), which fits its host,
all subdomains and every path that starts with its own, or a pattern: ``||``
stands for the beginning of a host's label, ``|`` for an end of the address, ``^``
for a separator or the end, ``*`` for anything.  Either becomes a regular
expression on the address, which is the URL after ``://`` without its fragment.

The index holds each rule once, under that of its whole literal tokens (letters
and digits between separators) which the fewest URLs of the table have.  A URL's
own tokens fetch their rules from a hashed table of fixed literals, a look-up of
constant time, and only the rules fetched run their expressions.  A rule without
a whole token is tried on every URL.  The path of the rows is one projection of
built-in functions: no shuffle, no join, no Python.  Rules are a parameter; more
than ``CHUNK`` of them go into further tables of that size.

The longest fitting prefix rule decides; only where none fits do patterns count,
those that allow before those that block; else the URL is allowed.

Defined cases: a null URL, and one without ``://``, has an empty host and path and
is allowed; a URL's host keeps a port or user that stands in it; only A-Z of a host
are lower-cased, paths keep their case; repeated rows have equal results; no rules
allow everything; columns of the input other than the two named are not used, so
none clashes.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of one look-up table.
CHUNK = 20_000

TOKEN = "[A-Za-z0-9]+"
#: What ``^`` stands for, beside an end.
SEPARATOR = r"[^A-Za-z0-9_.%\-]"
_ENTRY = "struct<token:string,rank:bigint,rule:string,verdict:string,prefix:boolean,regex:string>"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    pattern: bool = False

    def __post_init__(self):
        if self.verdict not in ("allow", "block") or not self.text.strip("|*^"):
            raise ValueError(f"not a rule: {self.verdict} {self.text}")


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9\u0080-\U0010ffff])", r"\\\1", text)


def expression(rule: Rule) -> str:
    """The regular expression, to be found anywhere in an address."""
    if not rule.pattern:
        host, slash, path = rule.text.partition("/")
        end = "/" + _quoted(path) if slash else r"(?:[/?]|\z)"
        return rf"\A(?:[^/?]*\.)?{_quoted(host)}{end}"
    text, start = rule.text, r"\A[\s\S]*?"
    if text.startswith("||"):
        start, text = r"\A(?:[^/?]*?\.)??", text[2:]
    elif text.startswith("|"):
        start, text = r"\A", text[1:]
    closed = text.endswith("|")
    parts = (text[:-1] if closed else text).split("*")
    out = ""
    for i, part in enumerate(parts):
        said = "".join(rf"(?:{SEPARATOR}|\z)" if c == "^" else _quoted(c) for c in part)
        # the first place of a part is the best one, so a part that was found is not tried
        # elsewhere, and the time is the address's length; a last one may have to be at the end
        if closed and i == len(parts) - 1:
            out += rf"{start if not i else r'[\s\S]*'}{said}\z"
        else:
            out += rf"(?>{start if not i else r'[\s\S]*?'}{said})"
    return out


def tokens(rule: Rule) -> list[str]:
    """The tokens that every fitting URL has as a whole."""
    text = rule.text
    if not rule.pattern:  # the path may go on inside its last token
        text = "|" + text + ("" if "/" in text else "|")
    found = [m for m in re.finditer(TOKEN, text) if m.start() > 0 and text[m.start() - 1] != "*" and m.end() < len(text) and text[m.end()] != "*"]
    return list(dict.fromkeys(m[0] for m in found))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")


def _parts(pages: DataFrame, key: str, url: str) -> DataFrame:
    """``key``, ``host``, ``path``, ``__address``."""
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("__url"))
    rows = rows.select("page_id", _after_scheme(F.col("__url")).alias("__rest"))
    rows = rows.select("page_id", "__rest", F.regexp_extract("__rest", r"\A([^/?#]*)", 1).alias("__host"))
    rows = rows.select("page_id", F.translate("__host", string.ascii_uppercase, string.ascii_lowercase).alias("host"), F.expr("substring(__rest, length(__host) + 1)").alias("__tail"))
    whole = F.concat("host", F.regexp_extract("__tail", r"\A([^#]*)", 1))
    return rows.select("page_id", "host", F.regexp_extract("__tail", r"\A([^?#]*)", 1).alias("path"), whole.alias("__address"))


def _tokens_of(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(address, F.lit(TOKEN), F.lit(0)))


def token_counts(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> dict[str, int]:
    """URLs of the table that have each token of the rules: one row a token reaches
    the driver, which has the rules already."""
    known = sorted({t for r in rules for t in tokens(r)})
    if not known:
        return {}
    own = F.array_intersect(_tokens_of(F.col("__address")), F.from_json(F.lit(json.dumps(known)), "array<string>"))
    counted = _parts(pages, key, url).select(F.explode(own).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return dict.fromkeys(known, 0) | {r["token"]: r["n"] for r in counted.collect()}


def _ranked(rules: Sequence[Rule]) -> list[Rule]:
    """Those that decide first come first; repeated rules once, the first given."""
    once = list({(r.pattern, r.text): r for r in reversed(rules)}.values())[::-1]
    prefixes = sorted((r for r in once if not r.pattern), key=lambda r: (-len(r.text), r.text))
    return prefixes + sorted((r for r in once if r.pattern), key=lambda r: r.verdict)


def _tables(rules: Sequence[Rule], counts: Mapping[str, int]) -> tuple[list[list[list[dict]]], list[dict]]:
    """Look-up tables by the hash of a token, and the rules that have none."""
    indexed, always = [], []
    for rank, r in enumerate(_ranked(rules)):
        token = min(tokens(r), key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
        entry = {"token": token, "rank": rank, "rule": r.text, "verdict": r.verdict, "prefix": not r.pattern, "regex": expression(r)}
        (always if token is None else indexed).append(entry)
    out = []
    for at in range(0, len(indexed), CHUNK):
        part = indexed[at : at + CHUNK]
        table: list[list[dict]] = [[] for _ in range(2 * len(part))]
        for e in part:
            table[zlib.crc32(e["token"].encode()) % len(table)].append(e)
        out.append(table)
    return out, always


def _fetched(found: Column, table: list[list[dict]]) -> Column:
    literal = F.from_json(F.lit(json.dumps(table)), f"array<array<{_ENTRY}>>")

    def of(token: Column) -> Column:
        place = (F.crc32(token.cast("binary")) % len(table)).cast("int")
        return F.filter(F.get(literal, place), lambda e: e["token"] == token)

    return F.flatten(F.transform(found, of))


def judge(pages: DataFrame, rules: Sequence[Rule], counts: Mapping[str, int], key: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, pattern)``: ``rule`` is the prefix rule that
    decided, ``pattern`` the pattern if none did."""
    tables, always = _tables(rules, counts)
    rows = _parts(pages, key, url).withColumn("__tokens", _tokens_of(F.col("__address")))
    fetched = [F.from_json(F.lit(json.dumps(always)), f"array<{_ENTRY}>")] if always else []
    for table in tables:
        fetched.append(_fetched(F.col("__tokens"), table))
    if not fetched:
        fetched = [F.from_json(F.lit("[]"), f"array<{_ENTRY}>")]
    fits = F.filter(F.concat(*fetched), lambda e: F.rlike(F.col("__address"), e["regex"]))
    best = F.array_min(F.transform(fits, lambda e: F.struct(e["rank"].alias("rank"), e["rule"].alias("rule"), e["verdict"].alias("verdict"), e["prefix"].alias("prefix"))))
    found = rows.select("page_id", "host", "path", best.alias("__best"))
    by = F.col("__best.prefix")
    return found.select("page_id", "host", "path", F.when(by, F.col("__best.rule")).alias("rule"), F.coalesce("__best.verdict", F.lit("allow")).alias("verdict"), F.when(~by, F.col("__best.rule")).alias("pattern"))
