"""URL filters: host/path rules, and block decisions carried along redirect and canonical links.

A rule is "host/path": it fits its host and all subdomains where the url's path starts with the rule's
path; of several that fit, the longest wins (of equally long ones an allow). A url that no rule fits takes the
decision of its aliases: urls joined by redirect or canonical-link edges form components (found by
distributed star contraction); an explicit allow rule on any member decides allow, else a block rule on any
member decides block, else allow. A url's own rule always stands before its aliases'.

Edge cases: a null url, or one without "://", has empty host and path and no alias; it is allowed. Edges with
a null or empty end are ignored. Repeated pages are judged one by one, and all their links count. Input columns named host,
path, rule or verdict give way to the operator's; other columns come along. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ascii_lower, join_groups, materialise
from tessera.llm.components import connected_components

#: (verdict, rule); judged as literal expressions, so the list is bounded.
Rules = Sequence[tuple[str, str]]
MAX_RULES = 2000
#: Parts of a page whose tags are no tags.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|noscript|template|xmp|iframe)\b.*?(?:</\1(?=[\s/>])|\z)"
LINK_TAG = r"(?i)<(?:link|meta|base)(?=[\s/])(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+>"
ATTRIBUTE = r"(?<=[\s/\"'])[^\s/>=\"'][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?"
#: What follows the seconds of a refresh.
REFRESH = r"(?is)^\s*(?:[0-9.]+(?:\s*[;,]|\s)\s*(?:url\s*=\s*)?|[;,\s]*url\s*=\s*)(.*)$"
#: Numeric references to the C1 controls mean these characters.
WINDOWS_1252 = {n: ord(bytes([n]).decode("cp1252")) for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Rules) -> Column:
    """struct(verdict, rule) of the rule that wins; null where none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0], r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rule_path))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def alias_key(url: Column) -> Column:
    """Node of the alias graph: the url without scheme and fragment, its host lower-cased; null without "://"."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, query))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that the plan holds once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def decode_references(value: Column) -> Column:
    """An attribute value with its character references decoded, by the rules of HTML for attributes."""
    named = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    special = F.from_json(F.lit(json.dumps(WINDOWS_1252)), "map<string,bigint>")
    limit = F.lit(0x110000).cast("long")

    def decode(piece: Column) -> Column:
        hexadecimal = F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]{1,7});?$", 1)
        decimal = F.regexp_extract(piece, r"^&#0*([0-9]{1,7});?$", 1)
        point = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("long")).when(decimal != "", decimal.cast("long")).when(F.rlike(piece, F.lit("^&#[xX]?[0-9a-fA-F]")), limit)
        named_char = F.coalesce(F.element_at(named, F.substr(piece, F.lit(2), F.length(piece))), piece)

        def char(point: Column) -> Column:
            valid = F.when((point > 0) & (point < limit) & ~point.between(0xD800, 0xDFFF), point).otherwise(F.lit(0xFFFD).cast("long"))
            return F.decode(F.unhex(F.lpad(F.hex(F.coalesce(F.element_at(special, point.cast("string")), valid)), 8, "0")), "UTF-32")

        return F.coalesce(bound(point, lambda n: F.when(n.isNotNull(), char(n))), named_char)

    pieces = F.regexp_extract_all(value, F.lit(r"(?s)&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[A-Za-z][A-Za-z0-9]*+[;=]?|&|[^&]++"), F.lit(0))
    return F.when(F.contains(value, F.lit("&")), F.array_join(F.transform(pieces, decode), "")).otherwise(value)


def attribute(tag: Column, name: str) -> Column:
    """Raw value of the first attribute of this name in a tag; empty without one."""
    found = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.rlike(a, F.lit(rf"(?is)^{name}(?:\s*=|$)")))
    value = F.regexp_extract(F.get(found, F.lit(0)), r"(?s)^[^=]+=\s*(.*)$", 1)
    return F.coalesce(F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2"), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without the segments "." and ".."."""
    up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", up(kept)).otherwise(F.concat(kept, F.array(s)))
    closed = F.regexp_replace(path, r"/(\.\.?)$", "/$1/")
    return F.array_join(F.aggregate(F.split(closed, "/"), F.array().cast("array<string>"), step), "/")


def resolved(target: Column, base: Column) -> Column:
    """Absolute url of a target as it stands on a page of url `base`; null if it has none, such as mailto:."""

    def resolve(target: Column, base: Column) -> Column:
        site = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
        path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
        own = F.regexp_extract(target, r"^([^?#]*)", 1)
        folder = F.concat(F.regexp_extract(path, r"^(.*)/", 1), F.lit("/"))
        joined = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))
        return (
            F.when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target)
            .when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")) | (site == ""), F.lit(None))
            .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^:]+:)", 1), target))
            .when(own != "", F.concat(site, without_dots(joined), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)))
            .when(F.startswith(target, F.lit("?")), F.concat(site, path, target))
            .otherwise(F.concat(F.regexp_extract(base, r"^([^#]*)", 1), target))
        )

    clean = F.regexp_replace(target, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]", "")
    return bound(clean, lambda t: bound(base, lambda b: resolve(t, b)))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source_url, target_url): canonical links and meta-refresh redirects of whole pages, as absolute urls.

    Targets are decoded and resolved against the page's url, or against its first <base href>. Comments, scripts
    and styles hold no links; an empty target is the page itself and is left out.
    """
    found = pages.select(F.col(url_col).alias("source_url"), F.col(html_col).alias("html")).where("source_url IS NOT NULL")
    found = found.where(F.contains(F.lower("html"), F.lit("canonical")) | F.contains(F.lower("html"), F.lit("http-equiv")))
    found = found.select("source_url", F.regexp_extract_all(F.regexp_replace("html", UNREAD, ""), F.lit(LINK_TAG), F.lit(0)).alias("tags"))
    found = materialise(found.where(F.size("tags") > 0), pages=F.count("*"))
    if not found.seen_on_the_way["pages"]:
        return found.select("source_url", F.lit(None).cast("string").alias("target_url"))
    based = F.get(F.filter("tags", lambda t: F.rlike(t, F.lit(r"(?is)^<base\b.*\shref\s*="))), F.lit(0))
    found = found.select("source_url", based.alias("based"), F.explode("tags").alias("tag"))
    raw = F.array(*(attribute(F.col("tag"), n) for n in ("rel", "href", "http-equiv", "content")), attribute(F.col("based"), "href"))
    found = found.select("source_url", F.lower(F.substr("tag", F.lit(2), F.lit(4))).alias("kind"), F.transform(raw, decode_references).alias("values"))
    found = found.select("source_url", "kind", *(F.get("values", F.lit(k)).alias(n) for k, n in enumerate(("rel", "href", "http_equiv", "content", "base_href"))))
    found = found.withColumn("base", F.coalesce(F.when(F.col("base_href") != "", resolved(F.col("base_href"), F.col("source_url"))), F.col("source_url")))
    canonical = F.when(F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical"), F.col("href"))
    content = F.regexp_replace(F.regexp_extract("content", REFRESH, 1), "(?s)^([\"'])(.*?)(?:\\1.*)?$", "$2")
    refresh = F.when(F.lower(F.trim("http_equiv")) == "refresh", content)
    found = found.select("source_url", "base", F.trim(F.when(F.col("kind") == "link", canonical).when(F.col("kind") == "meta", refresh)).alias("target"))
    found = found.where("target <> ''").select("source_url", resolved(F.col("target"), F.col("base")).alias("target_url"))
    return found.where("target_url IS NOT NULL")


def judge_urls(urls: DataFrame, links: DataFrame, rules: Rules, url_col: str = "url") -> DataFrame:
    """`urls` with host, path, rule and verdict added. links: source_url, target_url."""
    host, path = host_and_path(F.col(url_col))
    judged = urls.withColumns({"host": host, "path": path}).withColumn("_own", matching_rule(F.col("host"), F.col("path"), rules))
    ends = materialise(links.select(alias_key(F.col("source_url")).alias("a"), alias_key(F.col("target_url")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), edges=F.count("*"))
    verdict = F.coalesce("_own.verdict", F.lit("allow"))
    if ends.seen_on_the_way["edges"]:
        nodes = connected_components(ends, "a", "b")
        slash = F.concat(F.lit("x://"), F.col("node"))
        of_node = matching_rule(*host_and_path(slash), rules)["verdict"]
        nodes = materialise(nodes.withColumn("said", of_node))
        decided = materialise(nodes.groupBy("component").agg(F.min("said").alias("carried"), F.count("*").alias("n")))  # "allow" < "block"
        carried = join_groups(nodes, decided, "component", "n", F.col("node")).where("carried IS NOT NULL").select("node", "carried")
        judged = judged.withColumn("_key", alias_key(F.col(url_col)))
        pages = judged.where("_key IS NOT NULL").groupBy("_key").agg(F.count("*").alias("_pages"))
        carried = materialise(carried.join(pages, F.col("node") == F.col("_key")).select("_key", F.col("carried").alias("_carried"), "_pages"))
        # rows without a url have no key, and one url may stand on a third of all rows
        judged = join_groups(judged, carried, "_key", "_pages", F.monotonically_increasing_id().cast("string"))
        verdict = F.coalesce("_own.verdict", "_carried", F.lit("allow"))
    return judged.select(*(F.col(c) for c in urls.columns if c not in {"host", "path", "rule", "verdict"}), "host", "path", F.col("_own.rule").alias("rule"), verdict.alias("verdict"))
