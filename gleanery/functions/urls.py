"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The redirect and advertisement addresses of search pages.
REDIRECT = "duckduckgo.com/l/?uddg="
REDIRECT_PATH = "/l/?uddg="
ADS = ("duckduckgo.com", "bing.com/aclick")


def unwrap_redirect(href: Column) -> Column:
    """The target of a search page's redirect link; other links stay. A plus stays a plus."""
    target = F.regexp_extract(href, "uddg=([^&]*)", 1)
    wrapped = href.contains(REDIRECT) | href.startswith(REDIRECT_PATH)
    return F.when(wrapped, F.url_decode(F.replace(target, F.lit("+"), F.lit("%2B")))).otherwise(href)


def is_result(url: Column, title: Column) -> Column:
    """Whether a hit is a page of its own: http, titled, no advertisement."""
    out = url.startswith("http") & title.isNotNull()
    for part in ADS:
        out = out & ~url.contains(part)
    return out


def authority(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def domain_compatible(url: Column) -> Column:
    """The host without any leading w or dot characters."""
    return F.ltrim(authority(url), F.lit("w."))


def domain(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def extension(url: Column, kind: str = "process") -> Column:
    """File extension by what the address contains: kinds process, download, image, generic_image, generic_audio."""
    low = F.lower(url)
    if kind == "process":
        return F.when(low.contains(".mp3"), "mp3").when(low.contains(".wav"), "wav").when(low.contains(".ogg"), "ogg").otherwise("mp3")
    if kind == "download":
        return F.when(low.contains(".wav"), "wav").when(low.contains(".ogg"), "ogg").otherwise("mp3")
    default = "mp3" if kind == "generic_audio" else "jpg"
    return F.when(low.contains("png"), "png").when(low.contains("webp"), "webp").when(low.contains("wav"), "wav").otherwise(default)
