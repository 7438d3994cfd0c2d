"""URL filter with redirect equivalence: rules decide pages, and aliases (connected by redirect and canonical-link edges) take over block decisions."""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __post_init__(self):
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {self.verdict!r}")

    @property
    def text(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    raw = F.regexp_extract(_after_scheme(url), r"(?s)\A([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. Of equal length the first by text, block before allow."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text], r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


#: Query parameters that only say where a visitor came from.
TRACKING = r"utm_[^&#]*|gclid=[^&#]*|fbclid=[^&#]*"


def address(url: Column) -> Column:
    """One spelling for the addresses that a site answers alike: https, no www., default port, fragment, tracking parameters, index page or trailing slash; null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)\z", ""), r"\Awww\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.(html?|php)\z", "/"), r"/+\z", "")
    query = F.regexp_extract(F.regexp_replace(url, r"(?s)#.*", ""), r"(?s)\?(.*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(^|&)({TRACKING})(?=&|$)", ""), r"\A&+", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def absolute(link: Column, base: Column) -> Column:
    """The link as seen from base: whole, from its scheme, from its root or from its folder."""
    link = F.trim(link)
    scheme, root = F.regexp_extract(base, r"(?s)\A(.*?)://", 1), F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link)).when(link != "", F.concat(F.regexp_replace(folder, r"/\z", ""), F.lit("/"), link))
    )


_ATTR = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    found = [F.regexp_extract(tag, rf"(?is)\s{name}{_ATTR}", i) for i in (1, 2, 3)]
    return F.regexp_replace(F.concat(*found), "&amp;", "&")


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges (src, dst: urls) that pages tell of: their canonical link, og:url and the target of an immediate refresh."""
    html = F.coalesce(F.col("html"), F.lit(""))
    canonical = _attribute(F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\srel\s*=\s*["']?canonical\b)[^>]*>""", 0), "href")
    og = _attribute(F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\sproperty\s*=\s*["']?og:url\b)[^>]*>""", 0), "content")
    refresh = _attribute(F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\shttp-equiv\s*=\s*["']?refresh\b)[^>]*>""", 0), "content")
    target = F.regexp_extract(refresh, r"""(?is)\A\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s]+)""", 1)
    links = pages.select("url", F.explode(F.array(canonical, og, target)).alias("link")).where("link <> '' and url is not null")
    return links.select(F.col("url").alias("src"), absolute(F.col("link"), F.col("url")).alias("dst")).where("dst is not null")


def filter_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component.

    A page that a rule fits has the rule's verdict. Any other is blocked if an alias is blocked by a rule and no alias is allowed by one, and
    allowed otherwise. Aliases are the urls of one connected component. Its edges: from a url to its site's one spelling of it, where they differ, to the targets that its page tells
    of, and redirects (src, dst), if given. Ends that aren't pages take part, and the rules that fit them count. A null url or one without :// has empty host and path, no rule, no alias and is
    allowed; its component is null. Repeated urls are one alias with a row each; a null page_id is kept; urls and pages of any length are read whole; an empty table gives an empty result; other columns
    are not read. Of rules of equal length that fit, the first by text counts. The rule list is part of the plan and should stay below about 1,000.
    """
    scratch = Scratch(pages.sparkSession, "urlfilter")
    url = F.col("url")
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("fit", rule_for(rules, F.col("host"), F.col("path")))
    told = page_edges(pages)
    if redirects is not None:
        told = told.union(redirects.select("src", "dst"))
    told = scratch.cut(told.where(address(F.col("src")).isNotNull() & address(F.col("dst")).isNotNull()))
    ends = told.select(F.explode(F.array("src", "dst")).alias("url"))
    spelled = pages.select("url").union(ends).select(F.col("url").alias("a"), address(url).alias("b")).where("b is not null and a <> b")
    comp = scratch.cut(components(told.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(spelled), scratch))
    scratch.keep(told, comp)
    said = judged.select("url", "fit.verdict").union(ends.select("url", rule_for(rules, host_of(url), path_of(url)).getField("verdict"))).where("verdict is not null and url is not null")
    marks = said.groupBy("url").agg(F.bool_or(F.col("verdict") == "block").alias("block"), F.bool_or(F.col("verdict") == "allow").alias("allow"))
    roots = marks.join(comp, marks["url"] == comp["node"], "left").groupBy(F.coalesce("root", "url").alias("root")).agg(F.bool_or("block").alias("block"), F.bool_or("allow").alias("allow"))
    bad = roots.where("block and not allow").select("root", F.lit("block").alias("said"))
    rooted = judged.join(comp, judged["url"] == comp["node"], "left").select("page_id", "host", "path", "fit", F.when(F.col("host") != "", F.coalesce("root", "url")).alias("root"))
    out = rooted.join(bad, "root", "left")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "said", F.lit("allow")).alias("verdict"), F.col("root").alias("component"))
