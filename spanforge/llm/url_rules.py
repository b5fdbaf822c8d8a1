"""URL filters: pattern rules indexed by their rarest literal token.

A rule is compiled to a regular expression over host and path and filed under that of its literal tokens (host labels
and whole path segments) which occurs in the fewest URLs of the table. The tokens of a URL fetch its candidate rules;
only their expressions run. Of the rules that fit, the longest wins, then the first by code point. A list of rules travels
to the tasks (``judge``); a table of rules of any size is joined by token (``judge_by_table``), as a longer list is.

Defined results: a null url, or one without `://`, has an empty host and path and no rule; of rules with the same host and
path the first by verdict counts; no rules at all leave each url to the method's verdict; an empty table gives an empty
result; other columns, whatever their names, and repeated rows play no part, one row comes out for each row that goes in.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

DEFAULT = "allow"
#: Up to so many rules of up to so many characters in all travel to the tasks with the code; a larger list becomes a table.
LISTED_RULES, LISTED_LENGTH = 20_000, 1 << 20
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"(?s)(?:.*\.)?{re.escape(self.host)}\n{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every URL it fits has. The last segment of a path counts only if the path closes it."""
        return [f"h:{x}" for x in self.host.split(".")] + [f"p:{x}" for x in self.path.split("/")[1:-1] if x]


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

_UPPER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :])
    return rest[1].translate(_UPPER), rest[2]


def url_tokens(host: str, path: str) -> set[str]:
    return {f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in path.split("/") if x}


def token_counts(pages: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many URLs of the whole table each token of the rules occurs; at most one row for each of these tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})

    def count(batches):
        found: dict[str, int] = defaultdict(int)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for t in url_tokens(*split_url(url)).intersection(known):
                    found[t] += 1
        yield pa.RecordBatch.from_pydict({"token": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    known = frozenset(wanted)
    rows = pages.select("url").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return dict.fromkeys(wanted, 0) | {r["token"]: r["n"] for r in rows.collect()}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(rule)
    return dict(index)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    if len(rules) > LISTED_RULES or sum(len(r.name) + len(r.verdict) for r in rules) > LISTED_LENGTH:
        table = pages.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
        return judge_by_table(pages, table, default)
    rules = tuple({(r.host, r.path): r for r in sorted(rules, key=lambda r: r.verdict, reverse=True)}.values())
    index = rule_index(rules, token_counts(pages, rules))

    def run(batches):
        compiled = {t: [(re.compile(r.pattern), r) for r in found] for t, found in index.items()}
        for batch in batches:
            rows = []
            for page, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = split_url(url)
                candidates = [x for t in url_tokens(host, path) if t in compiled for x in compiled[t]]
                fits = [r for p, r in candidates if p.match(f"{host}\n{path}")]
                best = min(fits, key=lambda r: (-len(r.name), r.name), default=None)
                rows.append((page, host, path, best.name if best else None, best.verdict if best else default))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, SCHEMA)


def _parts(pages: DataFrame) -> DataFrame:
    """uid, page_id, host, path of every row; uid is stable once this is written."""
    url = F.col("url").cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    rows = rows.select("uid", "page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    upper, lower = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))
    host = F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), upper, lower)
    return rows.select("uid", "page_id", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def _tokens(host: str, path: Column) -> Column:
    named = lambda letter, parts: F.transform(parts, lambda x: F.concat(F.lit(letter), x))
    return F.array_distinct(F.concat(named("h:", F.split(host, r"\.")), named("p:", F.filter(path, lambda x: x != ""))))


def _quoted(x: str) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(F.col(x), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def judge_by_table(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``judge`` for a table of rules (host, path, verdict) of any size: tokens are counted, rules filed and candidates
    fetched by joins on the token; only candidates meet an expression."""
    rows = cut(_parts(pages), "url-parts")
    held = cut(rows.select("uid", F.explode(_tokens("host", F.split("path", "/"))).alias("token")), "url-tokens")
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("rule", F.concat("host", "path"))
    pattern = F.concat(F.lit(r"(?s)^(?:.*\.)?"), _quoted("host"), F.lit("\n"), _quoted("path"))
    inner = F.expr("slice(split(path, '/'), 2, greatest(size(split(path, '/')) - 2, 0))")  # the path's first part and its unclosed last one are no tokens
    rules = cut(rules.select("rule", "verdict", pattern.alias("pattern"), _tokens("host", inner).alias("tokens")), "url-rules")
    filed = rules.select("rule", F.explode("tokens").alias("token"))
    counts = held.join(filed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = filed.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = rarest.join(rules.select("rule", "verdict", "pattern"), "rule")
    met = held.join(index, "token").join(rows.select("uid", F.concat_ws("\n", "host", "path").alias("at")), "uid").where("at rlike pattern")
    best = met.groupBy("uid").agg(F.min(F.struct((-F.length("rule")).alias("longest"), "rule", "verdict")).alias("b"))
    return rows.join(best, "uid", "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def oracle(rules: tuple[Rule, ...] = RULES, default: str = DEFAULT) -> str:
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [(f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))", r) for r in longest]
    rule = " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in fits)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in fits)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE '{default}' END AS verdict FROM u"""
