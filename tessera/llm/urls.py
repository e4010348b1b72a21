"""URL filtering by rules, with decisions that follow redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, cut
from tessera.llm.graph import connected_components

#: Up to so many rules are written into the plan; more are joined by host suffix.
INLINE_RULES = 256
#: Rules in a joined table are broadcast up to this many (about 200 bytes each).
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _address(url: Column) -> Column:
    """A page's identity in the alias graph: host, path and query, without scheme and fragment; null without a host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), query))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)``: addresses of pages and of what they name as canonical or redirect to.

    Reads ``<link rel=canonical href=...>`` and ``<meta http-equiv=refresh content="0; url=...">``, in any
    number and either attribute order. Relative targets are resolved against the page. A tag ends at the
    next ``>``, and is none if ``<`` comes before it, so that time is linear in a page whatever it holds.
    """
    tag = F.col("tag")
    found = pages.select(F.col(url).alias("at"), F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<(?:link|meta)\b[^<>]*+>)"), 1)).alias("tag"))
    target = F.when(tag.rlike(r"(?is)^<link\b[^>]*\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    target = target.when(tag.rlike(r"(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    to, at = F.col("to"), F.col("at")
    full = F.when(to.rlike("(?s)^[^/?#]*://"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to))
    full = full.when(to.startswith("/"), F.concat(F.lit("http://"), host_of(at), to))
    full = full.otherwise(F.concat(F.lit("http://"), host_of(at), F.coalesce(F.nullif(F.regexp_extract(path_of(at), "(?s)^(.*/)", 1), F.lit("")), F.lit("/")), to))
    edges = found.select("at", target.alias("to")).where("to <> ''").select(_address(at).alias("src"), _address(full).alias("dst"))
    return edges.where("src <> dst").distinct()


def _inline(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _with_rules(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``own``, the longest rule that fits a row's ``host`` and ``path``."""
    if len(rules) <= INLINE_RULES:
        return rows.withColumn("own", _inline(rules, F.col("host"), F.col("path")))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    given = rows.sparkSession.createDataFrame(rules, "its_verdict string, h string, p string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = rows.select("row", "path", F.explode(suffixes).alias("h"))
    hits = near.join(F.broadcast(given) if len(rules) <= BROADCAST_RULES else given, "h").where(F.expr("startswith(path, p)"))
    rule = F.concat("h", "p")
    best = hits.groupBy("row").agg(F.max_by(F.struct(rule.alias("rule"), F.col("its_verdict").alias("verdict")), F.struct(F.length(rule), F.length("h"))).alias("own"))
    return rows.join(best, "row", "left").drop("row")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url: str = "url", html: str | None = "html", edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict, component)`` for every row.

    ``rules`` are ``(allow or block, host, path prefix)``; one fits its host and all subdomains if the
    path starts with its own; the longest wins, which settles allow against block. Addresses are aliases when
    a chain of redirects and canonical links joins them, in either direction; ``edges(src, dst)`` may add more,
    by address (host, path and query). Rules are asked of every address of a chain, a page of the table or not:
    a page without a rule is blocked if a rule blocks any alias of it, else gets ``default``; an
    explicit allow is a rule of its own and so never lost to an alias. ``component`` is the least address
    of a page's aliases, null if it has none. Null urls and urls without ``://`` have an empty host and
    path and fit no rule. Repeated rows are each judged; an empty table gives no row; other columns aren't read.
    """
    links = alias_edges(pages, url, html) if html else None
    more = edges.select("src", "dst") if edges is not None else None
    links = links.unionByName(more) if links is not None and more is not None else links if more is None else more
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), _address(F.col(url)).alias("address"))
    own = _with_rules(base, rules)
    out = [F.col("page_id"), F.col("host"), F.col("path"), F.col("own.rule").alias("rule")]
    links = cut(links) if links is not None else None
    alone = lambda rows: rows.select(*out, F.coalesce("own.verdict", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("component"))
    if links is None or links.isEmpty():
        return alone(own)
    nodes = connected_components(links).withColumnsRenamed({"node": "address"})
    asked = nodes.withColumns({"host": F.regexp_extract("address", "(?s)^[^/?#]*", 0), "path": F.regexp_extract("address", "(?s)^[^/?#]*([^?#]*)", 1)})
    blocked = _with_rules(asked, rules).where("own.verdict = 'block'").select("component", F.lit(True).alias("hit")).distinct()
    nodes = cut(nodes.join(blocked, "component", "left"))
    verdict = F.coalesce("own.verdict", F.when(F.col("hit"), "block"), F.lit(default))
    judged = own.where("address is not null").join(nodes, "address", "left").select(*out, verdict.alias("verdict"), "component")
    return judged.unionByName(alone(own.where("address is null")))  # never one key of a join
