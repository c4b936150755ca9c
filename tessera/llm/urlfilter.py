"""URL filters: pattern rules indexed by their rarest literal token (native: DataFrame functions only).

A rule is a regular expression over ``host + path`` with the literal tokens that every match must hold
as whole tokens (runs of ASCII letters and digits, lower-cased). How often each rule token occurs is
counted over all URLs, each rule is filed under its rarest token, and a URL fetches the rules filed
under its own tokens; only those run their expressions. Rules without a literal token run always.
The index is a constant of the plan (its size is that of the rule list), so a URL is judged inside its row: no join, no shuffle.

Listed rules (host, path) win over keyword rules, the longest first (ties by name); a URL that no listed rule
fits is blocked if a keyword rule fits, else allowed.

Defined cases: null URLs and URLs without ``://`` have empty host and path and are allowed; repeated rows are judged
each; URLs of any length are judged whole; an empty table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    name: str
    action: str
    regex: str
    literals: tuple[str, ...] = ()
    listed: bool = False
    rank: int = field(default=0)


def _quote(text: str) -> str:
    """Escapes every ASCII character that is not a letter or digit, so that Java reads it as itself."""
    return re.sub(r"([^A-Za-z0-9\u0080-\U0010ffff])", r"\\\1", text)


def listed_rule(action: str, host: str, path: str = "/") -> UrlRule:
    """Fits a host and all its subdomains where the path starts with ``path``. A last path token that may go on is no literal."""
    whole = re.findall(TOKEN, host.lower()) + re.findall(f"{TOKEN}(?=[^a-z0-9])", path.lower())
    return UrlRule(host + path, action, rf"^(?:[^\/]*\.)?{_quote(host)}{_quote(path)}", tuple(whole), True, len(host + path))


def keyword_rule(word: str) -> UrlRule:
    """Blocks hosts with ``word`` as one part between dots or hyphens."""
    return UrlRule(word, "block", rf"^(?:[^\/]*[.\-])?{_quote(word)}(?:[.\-:\/]|$)", tuple(re.findall(TOKEN, word.lower())))


LISTED = (
    listed_rule("allow", "com", "/"),
    listed_rule("block", "example.com", "/en/"),
    listed_rule("allow", "www.example.com", "/en/"),
    listed_rule("block", "net", "/es/"),
    listed_rule("block", "net", "/fr/"),
)
#: Host parts that a URL is blocked for: gambling, adult, drugs without prescription, loans and fakes, advertising and tracking, malware and piracy.
WORDS = (
    "casino bets bet365 poker gambling roulette slots jackpot lottery sportsbook "
    "porn xxx sex adult escort escorts camgirls hentai nude nsfw "
    "pills viagra cialis levitra tramadol xanax pharmacy steroids "
    "payday forex binaryoptions replica replicas fakeid cheapwatches "
    "ads adserver adservice adclick doubleclick popads clickbait track tracker tracking telemetry pixel affiliate spam "
    "malware phishing warez torrent torrents keygen crackz serials"
).split()
KEYWORDS = tuple(keyword_rule(w) for w in WORDS)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?:\/\/([^\/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?:\/\/[^\/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.concat(host, path), _UPPER, _LOWER), F.lit(TOKEN), F.lit(0)))


def token_counts(split: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, int]:
    """In how many URLs each literal token of the rules occurs; at most one row a rule token comes to the driver."""
    wanted = sorted({t for r in rules for t in r.literals})
    if not wanted:
        return {}
    tokens = F.array_intersect(tokens_of(F.col("host"), F.col("path")), F.array(*[F.lit(t) for t in wanted]))
    counted = split.select(F.explode(tokens).alias("token")).groupBy("token").count()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in counted.collect()}


def rule_index(rules: tuple[UrlRule, ...], counts: dict[str, int]) -> tuple[Column, Column, int]:
    """Hash buckets of (token, rule) entries and the rules that run always, as constants."""
    n = max(1, 2 * len(rules))
    buckets: list[list[dict]] = [[] for _ in range(n)]
    always = []
    for r in rules:
        entry = {"name": r.name, "action": r.action, "regex": r.regex, "listed": r.listed, "rank": r.rank}
        if r.literals:
            token = min(r.literals, key=lambda t: (counts.get(t, 0), -len(t), t))
            buckets[zlib.crc32(token.encode()) % n].append({"token": token} | entry)
        else:
            always.append({"token": ""} | entry)
    entry_type = "array<struct<token:string,name:string,action:string,regex:string,listed:boolean,rank:int>>"
    return F.from_json(F.lit(json.dumps(buckets)), f"array<{entry_type}>"), F.from_json(F.lit(json.dumps(always)), entry_type), n


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = LISTED + KEYWORDS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    split = pages.select(F.col("page_id"), F.col("url").cast("string").alias("_url")).select(
        "page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")
    )
    buckets, always, n = rule_index(rules, token_counts(split, rules))
    text = F.concat(F.col("host"), F.col("path"))
    fetched = F.flatten(
        F.transform(
            tokens_of(F.col("host"), F.col("path")),
            lambda t: F.filter(F.element_at(buckets, (F.crc32(t.cast("binary")) % n + 1).cast("int")), lambda e: e["token"] == t),
        )
    )
    fit = F.filter(F.concat(fetched, always), lambda e: F.rlike(text, e["regex"]))
    judged = split.withColumn("fit", fit)
    best = F.array_max(
        F.transform(F.filter("fit", lambda e: e["listed"]), lambda e: F.struct(e["rank"].alias("rank"), e["name"].alias("name"), e["action"].alias("action")))
    )
    other = F.when(F.exists("fit", lambda e: (~e["listed"]) & (e["action"] == "block")), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce(F.col("best.action"), other).alias("verdict")
    )


ORACLE = r"""
WITH a AS (SELECT page_id, url, CASE WHEN url IS NULL THEN 0 ELSE strpos(url, '://') END AS p FROM pages),
b AS (SELECT page_id, CASE WHEN p = 0 THEN '' ELSE substr(url, p + 3) END AS rest FROM a),
c AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM b),
d AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM c),
rules(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hit AS (
  SELECT d.page_id, d.host, d.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.action, length(r.h || r.p)) AS action
  FROM (SELECT *, row_number() OVER () AS n FROM d) d
  LEFT JOIN rules r ON (d.host = r.h OR ends_with(d.host, '.' || r.h)) AND starts_with(d.path, r.p)
  GROUP BY d.n, d.page_id, d.host, d.path)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN len(list_intersect(regexp_split_to_array(host, '[.:-]'), string_split('%s', ' '))) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM hit
""" % " ".join(WORDS)
