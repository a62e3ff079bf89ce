"""Pictures named by web pages: address checks, the page's own picture, and guarded fetching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

MAX_IMAGE, MAX_HTML = 10 << 20, 2 << 20
TIMEOUT_S, MAX_REDIRECTS = 15.0, 5
# The names under which pages state their picture.
PICTURE_NAMES = ["og:image", "twitter:image", "image_src"]


def is_web_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), F.lit(False))


#: A name and what stands behind its equals sign, in quotes or bare.
ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, in any case; null if it has none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), F.lower)
    values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2)
    at = F.array_position(names, name)
    return F.when(at > 0, F.regexp_replace(F.try_element_at(values, at.cast("int")), r"""^["']|["']$""", ""))


def absolute(base: Column, link: Column) -> Column:
    """A link against its page's address: full, scheme-relative, root-relative, relative with dots, or only ?query or #part."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*/)", 1)
    way, tail = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"([?#].*)$", 1)
    joined = F.concat(F.when(F.startswith(way, F.lit("/")), F.lit("")).otherwise(F.when(folder == "", "/").otherwise(folder)), way)
    slash = F.when(way.rlike(r"(^|/)\.{0,2}$"), "/").otherwise("")
    folded = F.concat(F.regexp_replace(paths.fold_dots(joined), "/$", ""), slash)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(way == "", F.concat(page, tail))
        .otherwise(F.concat(origin, folded, tail))
    )


def page_image(html: Column, url: Column) -> Column:
    """The first meta picture of the page, else its first img; web addresses only, &amp; read as &."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<((?:meta|img)\s[^>]*)>"), 1)
    is_img = lambda t: F.lower(F.substring(t, 1, 3)) == "img"

    def target(t: Column) -> Column:
        named = F.coalesce(attribute(t, "property"), attribute(t, "name")).isin(*PICTURE_NAMES)
        link = F.when(is_img(t), F.coalesce(attribute(t, "src"), attribute(t, "data-src"))).when(named, attribute(t, "content"))
        return F.struct(is_img(t).alias("img"), absolute(url, F.replace(link, F.lit("&amp;"), F.lit("&"))).alias("link"))

    usable = F.filter(F.transform(tags, target), lambda x: is_web_url(x["link"]))
    meta = F.try_element_at(F.filter(usable, lambda x: ~x["img"]), F.lit(1))
    img = F.try_element_at(F.filter(usable, lambda x: x["img"]), F.lit(1))
    return F.coalesce(meta["link"], img["link"])


def http_get(url: str, seconds: float = TIMEOUT_S, redirects: int = MAX_REDIRECTS) -> tuple[str, bytes]:
    """(content type, body) over HTTP. Reading stops one byte past the limit of the kind, so a body is never held beyond it."""
    from urllib import request

    class Few(request.HTTPRedirectHandler):
        max_redirections = redirects

    agent = request.Request(url, headers={"User-Agent": "Mozilla/5.0"})
    with request.build_opener(Few()).open(agent, timeout=seconds) as answer:
        kind = answer.headers.get_content_type()
        return kind, answer.read((MAX_IMAGE if kind.startswith("image/") else MAX_HTML) + 1)


def fetch(urls: DataFrame, get: Callable[[str], tuple[str, bytes]] = http_get) -> DataFrame:
    """urls (url) with content, kind and error. ``get(url)`` gives (content type, body) on the executors and is only
    called for web addresses; pictures over 10 MiB and pages over 2 MiB are refused."""

    @F.pandas_udf("content binary, kind string, error string")
    def run(url):
        import pandas as pd

        def one(u):
            try:
                kind, body = get(u)
            except Exception as e:  # noqa: BLE001  a page that can't be read is a result, not a failed job
                return None, None, f"network: {e}"
            most = MAX_IMAGE if kind.startswith("image/") else MAX_HTML
            return (None, kind, "too-large") if len(body) > most else (body, kind, None)

        return pd.DataFrame([one(u) for u in url], columns=["content", "kind", "error"])

    checked = urls.withColumn("got", F.when(is_web_url(F.col("url")), run("url")))
    return checked.select(*urls.columns, "got.content", "got.kind", F.when(is_web_url(F.col("url")), F.col("got.error")).otherwise("unsupported-protocol").alias("error"))
