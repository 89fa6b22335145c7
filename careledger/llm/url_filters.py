"""URL filters with redirect equivalence, in DataFrame functions.

URLs that redirect to each other, or name the same canonical link, are aliases. Aliases
are the connected components over those edges; a block decision on one of them holds for
all, unless an explicit allow decision is among them, which takes precedence. A URL's
own rule always comes first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careledger.llm.components import components
from careledger.llm.shared import cut, lowered

ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    """A verdict for a host with all its subdomains, under a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (text, verdict); null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict, r.text))
    fits = [
        (
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict")),
        )
        for r in ordered
    ]
    if not fits:
        return F.lit(None).cast("struct<text:string,verdict:string>")
    first, *others = fits
    return reduce(lambda cases, fit: cases.when(*fit), others, F.when(*first))


def canonical_url(url: Column) -> Column:
    """The URL that servers commonly redirect a URL to.

    https, host in lower case without ``www.`` or ``m.``, no fragment, no ``utm_`` or
    ``ref`` parameters, path without ``.html``, ``index`` or a last slash. A text without
    ``://`` is its own canonical form.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")), "&"
    )
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?|/+)?$", "")
    plain = F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, plain).otherwise(url)


#: Comments and elements whose content is no markup; one that does not end reaches to the end.
HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)" + "".join(
    rf"|{tag}\b.*?(?:</{tag}\b|\z)" for tag in ("script", "style", "textarea", "title", "noscript", "template")
)
HIDDEN += ")"
#: Named character references that URLs need.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decoded(text: Column) -> Column:
    """A text with its character references replaced, each once; unknown ones stay."""

    def character(number: Column, part: Column) -> Column:
        sound = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        rest = F.regexp_extract(part, r"(?s)^[^;]*;(.*)$", 1)
        return F.when(sound, F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))

    def part_of(part: Column) -> Column:
        decimal, hexadecimal = r"^#([0-9]{1,7});", r"^#[xX]([0-9a-fA-F]{1,6});"
        found = F.when(part.rlike(decimal), character(F.regexp_extract(part, decimal, 1).cast("int"), part))
        number = F.conv(F.regexp_extract(part, hexadecimal, 1), 16, 10).cast("int")
        found = found.when(part.rlike(hexadecimal), character(number, part))
        for name, char in _NAMED.items():
            found = found.when(part.startswith(name + ";"), F.concat(F.lit(char), F.substring(part, len(name) + 2, 2**31 - 1)))
        return found.otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    later = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), part_of)
    return F.when(F.instr(text, "&") == 0, text).otherwise(F.concat(parts[0], F.array_join(later, "")))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of this name as written; empty without one."""
    value = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.regexp_replace(value, r"(?s)^[\"']|[\"']$", "")


def _targets(tags: Column, name: str) -> Column:
    """The attributes of this name of an array of tags, decoded and trimmed, without empty ones."""
    # One step each, as a value that is used several times is then computed once.
    values = F.transform(F.transform(tags, lambda t: _attribute(t, name)), decoded)
    return F.filter(F.transform(values, lambda v: F.trim(v, F.lit(" \t\n\r\f"))), lambda v: v != "")


def _refresh_target(value: Column) -> Column:
    """Of what follows ``url=`` in a refresh, the URL without its quotes."""
    plain = value
    for quote in "\"'":
        plain = F.when(value.startswith(quote), F.regexp_extract(value, f"(?s)^{quote}([^{quote}]*)", 1)).otherwise(plain)
    return F.trim(plain)


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; above the root there is nothing."""

    def walked(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.array_append(kept, part))

    parts = F.split(path, "/")
    walk = F.array_join(F.aggregate(parts, F.array(F.lit("")).cast("array<string>"), walked), "/")
    # The text before the first slash is empty and stands in the start already.
    plain = F.regexp_replace(walk, r"^//", "/")
    ends = path.rlike(r"/\.{1,2}$") & ~plain.endswith("/")
    return F.when(ends, F.concat(plain, F.lit("/"))).otherwise(plain)


def absolute_url(target: Column, page: Column) -> Column:
    """A link's target, resolved against its page's URL; null if it names no page.

    Targets with a scheme stay as they are, those with one but no ``://``, as ``mailto:``,
    name no page, nor do relative ones on a page without ``://``.
    """
    scheme = F.regexp_extract(page, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    own = path_of(page)
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(own, r"(?s)^(.*/)", 1)
    full = (
        F.when(path.startswith("/"), path)
        .when(folder == "", F.concat(F.lit("/"), path))
        .otherwise(F.concat(folder, path))
    )
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (F.instr(page, "://") == 0), F.lit(None))
        .when(target == "", page)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(root, own, target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(page, r"(?s)^([^#]*)", 1), target))
        .otherwise(F.concat(root, _without_dots(full), rest))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(source, target): the redirect and canonical-link edges that pages give.

    A page's canonical links, its ``refresh`` redirects, and the server redirects to the
    canonical forms of its own URL and of those targets. Targets are resolved against the
    page's first ``<base href>``, if it has one. Comments, scripts and the like hold no links;
    empty targets name nothing. Null URLs give none.
    """
    url = F.col("url")
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, " ")
    tags = pages.filter(url.isNotNull()).select(
        url, F.regexp_extract_all(shown, F.lit(r"(?is)(<(?:link|meta|base)\b[^>]*>)"), 1).alias("tags")
    )
    linked = F.filter(
        "tags",
        lambda t: t.rlike(r"(?i)^<link\b")
        & F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"),
    )
    moved = F.filter(
        "tags", lambda t: t.rlike(r"(?i)^<meta\b") & (F.trim(F.lower(_attribute(t, "http-equiv"))) == "refresh")
    )
    urls = F.transform(
        _targets(moved, "content"),
        lambda v: F.regexp_extract(v, r"(?is)^[0-9.\s]*[;,\s]\s*url\s*=\s*(.*)$", 1),
    )
    declared = F.array_union(
        _targets(linked, "href"), F.filter(F.transform(urls, _refresh_target), lambda v: v != "")
    )
    bases = F.transform(
        F.slice(_targets(F.filter("tags", lambda t: t.rlike(r"(?i)^<base\b")), "href"), 1, 1),
        lambda t: absolute_url(t, url),
    )
    # Most pages have no such tag.
    none = F.array().cast("array<string>")
    some = F.size("tags") > 0
    read = tags.select(
        url, F.when(some, bases).otherwise(none).alias("bases"), F.when(some, declared).otherwise(none).alias("declared")
    ).withColumn("base", F.coalesce(F.get("bases", F.lit(0)), url))
    found = F.filter(F.transform("declared", lambda t: absolute_url(t, F.col("base"))), lambda t: t.isNotNull())

    def edge(source: Column, target: Column) -> Column:
        return F.struct(source.alias("source"), target.alias("target"))

    pairs = F.flatten(F.transform(found, lambda t: F.array(edge(url, t), edge(t, canonical_url(t)))))
    edges = F.explode(F.array_append(pairs, edge(url, canonical_url(url)))).alias("edge")
    return read.select(edges).select("edge.source", "edge.target").distinct()


def judge(pages: DataFrame, edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, alias and how the verdict came, per page.

    ``edges`` holds (source, target) URLs. A page without a rule is blocked if an alias
    is and none is allowed by rule, else allowed. Null URLs and texts without ``://`` have
    an empty host and path and no rule; they are allowed, unless such a text has aliases.
    Repeated rows are judged alike; other columns are not read.
    """
    # Written, as the components read it several times and pages need parsing once.
    nodes = components(cut(edges, "edges"), "source", "target").withColumnRenamed("node", "url")
    url = F.col("url")
    ruled = fitting_rule(host_of(url), path_of(url), rules)
    # One row per component. Only its summary is joined back.
    groups = (
        nodes.withColumn("verdict", ruled["verdict"])
        .groupBy("component")
        .agg(
            F.coalesce(F.bool_or(F.col("verdict") == ALLOW), F.lit(False)).alias("any_allow"),
            F.coalesce(F.bool_or(F.col("verdict") == BLOCK), F.lit(False)).alias("any_block"),
        )
        .filter("any_block and not any_allow")
        .select("component")
    )
    aliases = nodes.join(groups.withColumn("blocked", F.lit(True)), "component", "left")
    own = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    inherited = F.when(F.col("blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    # Null URLs have no alias and are spread by their own key.
    hole = F.when(url.isNull(), 1 + F.pmod(F.xxhash64("page_id"), F.lit(100_000))).otherwise(F.lit(0).cast("bigint"))
    own, aliases = own.withColumn("hole", hole), aliases.withColumn("hole", F.lit(0).cast("bigint"))
    return own.join(aliases, ["url", "hole"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.text").alias("rule"),
        F.coalesce("fit.verdict", inherited).alias("verdict"),
        F.coalesce("component", "url").alias("alias"),
        F.when(F.col("fit").isNotNull(), "rule").when(F.col("blocked"), "alias").otherwise("default").alias("decided_by"),
    )
