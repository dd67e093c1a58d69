"""URL filters: pattern rules indexed by their rarest literal token.

Pattern language: literal text with `*` (any run), `^` (a separator or the end), `||` at the start (a host
name's start), `|` at either end (the url's start or end), `@@` before all of it (an exception, allows).
Patterns are matched without regard to the case of A-Z.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamesh.llm._io import beside

#: Words that begin host names of gambling, adult, advertising, tracking, pharmacy and piracy sites.
HOST_WORDS = (
    "casino casinos poker roulette slots jackpot lottery bet bets betting bookmaker adult xxx porn escorts webcam ads adserver adservice "
    "banners popunder tracker tracking clicktrack payday replica viagra cialis pharmacy-online warez torrents keygen cracked serials"
).split()
#: The rules of the registered query.
DEFAULT_RULES = (
    *(f"||{word}{end}" for word in HOST_WORDS for end in "-."),
    "||free-bets.",
    "||online-casino.",
    "||sports-betting.",
    "||live-cams.",
    "||spam-farm.",
    "||cheap-pills.",
    "||casino-bonus.",
    "||tracker.*/pixel^",
    "/wp-login.php",
    "/ads/banner/",
    "&clickid=",
    "?sessionid=*&redirect=",
    "||phish*.example.",
    "@@||spam-farm.example.org/en/abuse",
    "@@||cheap-pills.*/en/recall^",
)
#: Fixed values: (host and path, verdict), of which the longest that fits wins over all patterns.
BASE_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps the token index is dealt over; each stays small for as many rules as MAX_RULES.
BUCKETS = 64
#: filter_urls() holds its index as a literal of the plan, so its size is bounded; filter_urls_by_table() takes longer lists.
MAX_RULES = 20_000


def lowered(col: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(col, UPPER, LOWER)


def to_regex(rule: str) -> str:
    """The rule's pattern as a regular expression over a lower-cased url."""
    body = rule.removeprefix("@@")
    head, tail = "(?s)", ""
    if body.startswith("||"):
        head, body = r"(?s)^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "(?s)^", body[1:]
    if body.endswith("|"):
        tail, body = r"\z", body[:-1]
    body = body.translate(str.maketrans(UPPER, LOWER))
    return head + "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\z)"}.get(c) or re.sub(r"([^a-z0-9])", r"\\\1", c) for c in body) + tail


def literal_tokens(rule: str) -> list[str]:
    """Runs of [a-z0-9] that every matching url holds as whole tokens: bounded on both sides by other literal characters, separators or anchors."""
    body = rule.removeprefix("@@").translate(str.maketrans(UPPER, LOWER))
    left = body.startswith("|")
    right = body.endswith("|")
    body = body.strip("|")
    out = []
    for m in re.finditer(r"[a-z0-9]+", body):
        begins = left if m.start() == 0 else body[m.start() - 1] != "*"
        ends = right if m.end() == len(body) else body[m.end()] != "*"
        if begins and ends:
            out.append(m[0])
    return out


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lowered(url), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(pages: DataFrame, url: str, rules: Sequence[str]) -> tuple[dict[str, list[int]], list[int]]:
    """(token -> rules to try, rules without a token). A rule stands under the one of its tokens that fewest urls of `pages` hold.

    Only tokens of rules are counted, so the driver gets a row for each of them at most.
    """
    tokens = {i: literal_tokens(r) for i, r in enumerate(rules)}
    asked = sorted({t for ts in tokens.values() for t in ts})
    wanted = F.array(*(F.lit(t) for t in asked)) if asked else F.array().cast("array<string>")
    counts = pages.select(F.explode(F.array_intersect(url_tokens(F.col(url)), wanted)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    seen = {r["t"]: r["n"] for r in counts.collect()}
    index: dict[str, list[int]] = {}
    rest = []
    for i, ts in tokens.items():
        if ts:
            index.setdefault(min(ts, key=lambda t: (seen.get(t, 0), t)), []).append(i)
        else:
            rest.append(i)
    return index, rest


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to `/`, `?`, `#` or the end, lower-cased; then up to `?`, `#` or the end. Both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return (lowered(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def base_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = BASE_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent domain of it and whose path begins the url's; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{tail}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _literal(value: list, ddl: str) -> Column:
    """A nested constant; folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def filter_urls(pages: DataFrame, url: str = "url", rules: Sequence[str] = DEFAULT_RULES, index: tuple[dict[str, list[int]], list[int]] | None = None, tried: str = "n_tried", matched: str = "matched", verdict: str = "pattern_verdict") -> DataFrame:
    """Adds `tried` (regular expressions run for the url), `matched` (the rules that match, in the list's order) and `verdict`.

    A url's tokens fetch the rules that stand under them; only those, and the rules without any token, run their
    regular expressions. The verdict is block if a rule matches and no exception does, else allow.
    Null and empty urls have no tokens and match nothing but rules that match the empty text. Repeated rows are
    judged alike; columns of the added names are replaced, all others stay. One pass, no shuffle; the pass that counts tokens reads the url column alone.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index holds {MAX_RULES}: use filter_urls_by_table()")
    by_token, rest = rule_index(pages, url, rules) if index is None else index
    entry = lambda i: {"id": i, "allow": rules[i].startswith("@@"), "re": to_regex(rules[i])}
    kind = "array<struct<id:int,allow:boolean,re:string>>"
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for t, ids in by_token.items():
        buckets[sum(t.encode()) % BUCKETS][t] = [entry(i) for i in ids]
    # a token's bucket, on the JVM: the sum of its code units
    place = lambda t: F.aggregate(F.split(t, ""), F.lit(0), lambda a, c: a + F.ascii(c)) % BUCKETS + 1
    maps = _literal(buckets, f"array<map<string,{kind}>>")
    known = F.array(*(F.lit(t) for t in sorted(by_token))) if by_token else F.array().cast("array<string>")
    always = _literal([entry(i) for i in rest], kind)
    names = F.array(*(F.lit(r) for r in rules)) if rules else F.array().cast("array<string>")

    def work(df: DataFrame) -> DataFrame:
        hits = F.array_intersect(url_tokens(F.col("low")), known)
        fetched = F.flatten(F.transform(hits, lambda t: F.element_at(F.element_at(maps, place(t).cast("int")), t)))
        df = df.withColumn("fetched", F.concat(fetched, always))
        ran = F.filter(F.col("fetched"), lambda r: F.call_function("rlike", F.col("low"), r["re"]))
        df = df.withColumn("hit", F.array_sort(ran))
        return df.withColumns({
            "tried": F.size("fetched"),
            "matched": F.transform("hit", lambda r: F.element_at(names, r["id"] + 1)),
            "verdict": F.when(F.exists("hit", lambda r: ~r["allow"]) & ~F.exists("hit", lambda r: r["allow"]), F.lit("block")).otherwise(F.lit("allow")),
        })

    return beside(pages, {"low": lowered(F.coalesce(F.col(f"`{url}`"), F.lit("")))}, work, {tried: "tried", matched: "matched", verdict: "verdict"})


def filter_urls_by_table(pages: DataFrame, rules: DataFrame, url: str = "url", rule: str = "rule", tried: str = "n_tried", matched: str = "matched", verdict: str = "pattern_verdict") -> DataFrame:
    """filter_urls() for rules in a column of a table, of any number: nothing of them is a part of the plan or comes to the driver.

    Distinct urls meet rules in a join by token; a rule stands under the one of its tokens that fewest distinct urls hold, and
    rules without a token meet every distinct url. `matched` is in the order of the rules' text; null rules are none,
    repeated ones count once. Rules are parsed by Python, urls aren't.
    """
    own = rules.select(F.col(f"`{rule}`").alias("rule")).where("rule IS NOT NULL").distinct()
    regex = F.arrow_udf(lambda a: pa.array([to_regex(r) for r in a.to_pylist()], pa.string()), "string")
    tokens = F.arrow_udf(lambda a: pa.array([literal_tokens(r) for r in a.to_pylist()], pa.list_(pa.string())), "array<string>")
    parsed = own.select("rule", F.col("rule").startswith("@@").alias("allow"), regex("rule").alias("re"), tokens("rule").alias("ts"))

    def work(df: DataFrame) -> DataFrame:
        urls = df.select("low").distinct()
        words = urls.select("low", F.explode(url_tokens(F.col("low"))).alias("t"))
        asked = parsed.select("rule", F.explode("ts").alias("t"))
        counts = words.join(asked.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        rarest = asked.join(counts, "t", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")).alias("at"))
        fetched = words.join(parsed.join(rarest.select("rule", F.col("at.t").alias("t")), "rule"), "t").select("low", "rule", "allow", "re")
        always = urls.crossJoin(parsed.where(F.size("ts") == 0)).select("low", "rule", "allow", "re")  # both sides distinct; such rules have to run on every url
        ran = fetched.unionByName(always).withColumn("fits", F.call_function("rlike", F.col("low"), F.col("re")))
        judged = ran.groupBy("low").agg(
            F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.when(F.col("fits"), F.col("rule")))).alias("hit"),
            (F.max(F.col("fits") & ~F.col("allow")) & ~F.max(F.col("fits") & F.col("allow"))).alias("block"))
        return df.join(judged, "low", "left").withColumns({
            "tried": F.coalesce("n", F.lit(0)), "matched": F.coalesce("hit", F.array().cast("array<string>")),
            "verdict": F.when(F.col("block"), F.lit("block")).otherwise(F.lit("allow")),
        })

    return beside(pages, {"low": lowered(F.coalesce(F.col(f"`{url}`"), F.lit("")))}, work, {tried: "tried", matched: "matched", verdict: "verdict"})


def base_rule_sql(rules: Sequence[tuple[str, str]] = BASE_RULES) -> tuple[str, str]:
    """base_rule() in DuckDB's SQL, over columns host and path."""
    rule = verdict = "NULL"
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, tail = text.partition("/")
        fits = f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{tail}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    return rule, verdict
