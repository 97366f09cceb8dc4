"""URL filtering by redirect equivalence.

Redirects and canonical links say that two URLs are one document. Their connected components are
found by distributed star steps; a rule that blocks one URL then blocks its aliases.

Decisions, the first that applies:

1. the longest rule that fits the URL itself (of equal ones one that allows);
2. ``allow`` where a rule allows any URL of its component: an explicit allow goes before blocks;
3. ``block`` where a rule blocks any URL of its component;
4. ``allow``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import store
from keelson.llm.components import connected_components
from keelson.session import salted_join


class Rule(NamedTuple):
    """A host with all its subdomains and the beginning of a path."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
)
#: Rules are written into the plan; more of them belong into a joined table.
MAX_RULES = 1_000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(
        F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule that fits, as struct of ``rule`` and ``allow``; null if there is none.

    Of rules of one length the one that allows goes first, then the least text.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"More than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule: string, allow: boolean>")
    order = sorted(rules, key=lambda r: (len(r.text), r.allow, [-ord(c) for c in r.text]))
    for rule in order:  # the last one written is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(
            fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.allow).alias("allow"))
        ).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """The name of a URL in the link graph; null for one without ``://``.

    Scheme and host are lower-cased, the fragment (which no server sees) goes, and an empty path
    is ``/``.
    """
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    path = path_of(url)
    name = F.concat(
        scheme, F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), rest
    )
    return F.when(url.contains("://"), name)


# -- edges of pages ------------------------------------------------------------------------------

#: Comments and elements whose content is no markup, whole; of the tags that can name an alias,
#: the tag. The quantifiers are possessive: no backtracking, no recursion on long pages.
_TAGS = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<(?:script|style|template|noscript|textarea|title|xmp)\b.*?(?:</(?:script|style|template|noscript|textarea|title|xmp)\b|\z)"
    r"""|<(?:link|meta|base)\b(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>"""
)


class _Head(HTMLParser):
    """The alias that a page's link, meta and base tags name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.base: str | None = None
        self.targets: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {name: value or "" for name, value in reversed(attrs)}  # the first of a name counts
        if tag == "base" and self.base is None and own.get("href"):
            self.base = own["href"]
        elif tag == "link" and "canonical" in own.get("rel", "").lower().split():
            self.targets.append(own.get("href", "").strip())
        elif tag == "meta" and own.get("http-equiv", "").strip().lower() == "refresh":
            self.targets.append(_refresh_target(own.get("content", "")))

    handle_startendtag = handle_starttag


def _refresh_target(content: str) -> str:
    """The URL of ``seconds; url=...``; empty if the page only reloads itself."""
    _, mark, rest = content.replace(",", ";", 1).partition(";")
    rest = rest.strip()
    name, equals, value = rest.partition("=")
    if mark and equals and name.strip().lower() == "url":
        rest = value.strip()
    if rest[:1] in ("'", '"'):
        rest = rest[1:].split(rest[0], 1)[0]
    return rest.strip()


def alias_targets(url: str, tags: Sequence[str]) -> list[str]:
    """Absolute URLs of the canonical links and refreshes among ``tags``; broken ones are left out."""
    head = _Head()
    for tag in tags:
        head.feed(tag)
    found = []
    for target in head.targets:
        if target:
            try:
                found.append(urljoin(urljoin(url, head.base or ""), target))
            except ValueError:  # such as an open bracket for a host
                continue
    return found


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls, tags = (c.to_pylist() for c in batch.columns)
        pairs = [(u, t) for u, own in zip(urls, tags, strict=True) for t in alias_targets(u, own)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["from_url", "to_url"]
        )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``from_url``, ``to_url``: canonical links and refreshes of all pages.

    Tags inside comments, scripts and the like do not count. The tags are cut out by one pattern;
    only pages that have such a tag reach Python. Pages without URL or html give no edges.
    """
    tags = F.filter(
        F.regexp_extract_all(F.col(html), F.lit(_TAGS), F.lit(0)),
        lambda tag: tag.rlike(r"(?i)^<(?:link|meta|base)\b"),
    )
    return (
        pages.where(F.col(url).contains("://"))
        .where(F.col(html).rlike(r"(?i)canonical|refresh"))
        .select(F.col(url).alias("url"), tags.alias("tags"))
        .where(F.exists("tags", lambda tag: tag.rlike(r"(?i)canonical|refresh")))
        .mapInArrow(_targets, "from_url string, to_url string")
    )


# -- decisions -----------------------------------------------------------------------------------


def alias_decisions(links: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For every linked URL ``node`` of a component with rules: ``allow``, the component's decision.

    ``links`` has the columns ``from_url`` and ``to_url``; null and URLs without ``://`` are no
    nodes. Components are judged by one aggregate over their nodes' own rules, and the decision is
    joined back salted, so a component of any size is spread over tasks.
    """
    edges = links.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v"))
    members = store(connected_components(edges.where("u is not null and v is not null")))
    named = members.select("node", "component").unionByName(
        members.select(F.col("component").alias("node"), "component").distinct()
    )
    own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    decided = (
        named.groupBy("component")
        .agg(F.max(own["allow"]).alias("allow"))  # true is the larger one: allow goes first
        .where("allow is not null")
    )
    return salted_join(named.distinct(), decided, ["component"], ["node"]).select("node", "allow")


def judge_urls(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """A verdict for every row of ``pages``: the key, ``host``, ``path``, ``rule`` and ``verdict``.

    ``redirects`` may bring further links (``from_url``, ``to_url``), such as a crawler's log. A
    null URL or one without ``://`` has empty host and path, fits no rule, is no alias of anything
    and is allowed. Repeated rows and keys are judged each. Further columns are not read; an empty
    table gives no rows.
    """
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    decisions = alias_decisions(store(links), rules)
    rows = pages.select(
        F.col(key),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        node_of(F.col(url)).alias("node"),
    ).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    # Rows with their own rule, and those without a node, need no decision of a component.
    open_rows = F.col("own").isNull() & F.col("node").isNotNull()
    judged = salted_join(
        rows.where(open_rows), decisions, ["node"], [f"`{key}`"], how="left"
    ).unionByName(rows.where(~open_rows).withColumn("allow", F.lit(None).cast("boolean")))
    allowed = F.coalesce(F.col("own.allow"), F.col("allow"), F.lit(True))
    return judged.select(
        key, "host", "path", F.col("own.rule").alias("rule"), F.when(allowed, "allow").otherwise("block").alias("verdict")
    )
