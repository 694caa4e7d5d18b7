"""Masking, names, paths and error categories."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that no file may have.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
#: What an error's message holds, in the order of the tests.
ERROR_TERMS = {
    "timeout": ["timeout"],
    "rate_limit": ["rate limit", "too many", "429", "throttl"],
    "network": ["net::", "connection", "network", "dns", "socket"],
    "auth": ["login", "auth", "credential", "password", "401", "403"],
    "not_found": ["not found", "404", "does not exist", "no such"],
    "browser": ["browser", "page", "context", "target closed", "crashed"],
}
RETRYABLE = ["network", "timeout", "rate_limit", "proxy"]
#: Phrases by which platforms say that they block.
BLOCK_PHRASES = {
    "facebook": ["you're temporarily blocked", "temporarily blocked", "try again later", "slow down", "too many requests", "rate limit", "estás bloqueado temporalmente", "intenta de nuevo más tarde", "demasiadas solicitudes"],
    "instagram": ["try again later", "please wait", "action blocked", "temporarily blocked", "too many requests", "we limit how often", "suspicious activity"],
    "twitter": ["rate limit exceeded", "try again later", "something went wrong", "over capacity", "too many requests"],
    "linkedin": ["unusual activity", "security verification", "too many requests", "please try again", "temporarily restricted"],
}
#: Parts of URLs to which platforms send a client that they block.
BLOCK_URLS = {"facebook": ["/checkpoint/", "/accounts/suspended"], "instagram": ["/challenge/", "/accounts/suspended", "/accounts/consent"], "linkedin": ["/checkpoint/", "/authwall"]}
_SECRETS = "password|secret|token|api_key"
#: What a key that names a secret holds.
SECRET_KEYS = ["password", "secret", "token", "api_key", "apikey", "auth", "credential", "private"]
_SECRET_KEY = f"(?i)({'|'.join(SECRET_KEYS)})"


def mask_credential(c: Column, visible: int = 3) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) <= visible, F.coalesce(F.repeat(F.lit("*"), F.length(c)), F.lit(""))).otherwise(F.concat(F.left(c, F.lit(visible)), F.lit("***")))


def mask_email(c: Column) -> Column:
    local, domain = F.regexp_extract(c, "^(?s)(.*)@([^@]*)$", 1), F.regexp_extract(c, "^(?s)(.*)@([^@]*)$", 2)
    masked = F.when(F.contains(domain, F.lit(".")), F.concat(mask_credential(F.substring_index(domain, ".", 1)), F.lit("."), F.substring_index(domain, ".", -1))).otherwise(mask_credential(domain))
    return F.when(F.contains(c, F.lit("@")), F.concat(mask_credential(local), F.lit("@"), masked)).otherwise(mask_credential(c))


def mask_url(c: Column) -> Column:
    host = F.substring_index(c, "@", -1)
    scheme = F.regexp_extract(F.substring_index(c, "@", 1), "^(.*?)://", 1)
    return F.coalesce(F.when(~F.contains(c, F.lit("@")), c).when(scheme != "", F.concat(scheme, F.lit("://***@"), host)).otherwise(F.concat(F.lit("***@"), host)), F.lit(""))


def mask_log(c: Column) -> Column:
    """Values after password, secret, token and api_key keep three characters."""
    short = F.regexp_replace(c, rf"""(?i)((?:{_SECRETS})[=:]\s*["']?)([^"'\s,}}]{{3}})[^"'\s,}}]+""", "$1$2***")
    return F.regexp_replace(short, rf"""(?i)((?:{_SECRETS})[=:]\s*["']?)[^"'\s,}}]{{1,3}}(?=["'\s,}}]|$)""", "$1***")


def mask_map(c: Column) -> Column:
    """Values of keys that name a secret, in a map of strings; ``mask_json`` reaches into what is nested."""
    return F.transform_values(c, lambda k, v: F.when(k.rlike(_SECRET_KEY), mask_credential(v)).otherwise(v))


def _masked(v: Column, levels: int) -> Column:
    """A variant's object, walked down so many levels, and null for other variants. What a value is shows in whether it can be taken as a map or a list, so that no value is walked to its leaves on each level to name its type."""
    as_a = lambda x, kind: F.try_variant_get(x, "$", kind)

    def item(x: Column) -> Column:
        return x if levels == 1 else F.coalesce(_masked(x, levels - 1), x)

    def value(k: Column, x: Column) -> Column:
        secret = k.rlike(_SECRET_KEY) & (F.schema_of_variant(x) == "STRING")
        listed = F.to_variant_object(F.transform(as_a(x, "array<variant>"), item))
        return F.when(secret, mask_credential(as_a(x, "string")).cast("variant")).otherwise(F.coalesce(listed, item(x)))

    return F.to_variant_object(F.transform_values(as_a(v, "map<string,variant>"), value))


def mask_json(c: Column, levels: int = 5) -> Column:
    """A JSON object as text in which strings under keys that name a secret are masked, in objects within objects and lists down to ``levels`` of objects; what lies below, and lists within lists, stays. Keys come out in alphabetical order; text that is no JSON object gives null, as nothing can be said of it."""
    return F.to_json(_masked(F.try_parse_json(c), levels))


def name_error(c: Column) -> Column:
    """Why a client or account name is refused; null if it isn't."""
    return (
        F.when(c.isNull() | (c == ""), F.lit("empty"))
        .when(F.length(c) > 100, F.lit("too long"))
        .when(~c.rlike(r"^[a-zA-Z0-9_\-.]+$"), F.lit("invalid characters"))
        .when(F.contains(c, F.lit("..")), F.lit("dangerous pattern"))
        .when(F.upper(F.substring_index(c, ".", 1)).isin(RESERVED), F.lit("reserved"))
    )


def sanitise_filename(c: Column) -> Column:
    bare = F.replace(F.btrim(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(". ")), F.lit(".."), F.lit("_"))
    named = F.left(F.when(bare == "", F.lit("unnamed")).otherwise(bare), F.lit(255))
    return F.when(F.upper(F.substring_index(named, ".", 1)).isin(RESERVED), F.concat(F.lit("_"), named)).otherwise(named)


def sanitise_component(c: Column) -> Column:
    """A name as one part of a path, in lower case: separators, wildcards, quotes, spaces and double dots become _."""
    flat = F.replace(F.regexp_replace(F.lower(F.trim(c)), r'[/\\:*?"<>| ]', "_"), F.lit(".."), F.lit("_"))
    bare = F.btrim(flat, F.lit("_."))
    named = F.when(F.coalesce(bare, F.lit("")) == "", F.lit("unnamed")).otherwise(bare)
    return F.when(F.upper(F.substring_index(named, ".", 1)).isin(RESERVED), F.concat(F.lit("_"), named)).otherwise(named)


def path_leaves(c: Column) -> Column:
    """Whether a relative path would leave its base: an absolute one, a home, or any part that is two dots."""
    return F.coalesce(c.rlike(r"^[/\\~]|^[a-zA-Z]:") | F.array_contains(F.split(c, r"[/\\]"), ".."), F.lit(False))


def within(base: str, *parts: str) -> str:
    """A path below ``base``; raises ValueError for what would leave it. Used on the driver before writes."""
    for p in parts:
        if p.startswith(("/", "\\", "~")) or ".." in PurePosixPath(p.replace("\\", "/")).parts:
            raise ValueError(f"{p!r} leaves {base!r}")
    return "/".join([base.rstrip("/"), *parts])


def error_category(c: Column) -> Column:
    t = F.lower(c)
    out = F
    for name, terms in ERROR_TERMS.items():
        out = out.when(F.coalesce(*[F.when(F.contains(t, F.lit(x)), True) for x in terms], F.lit(False)), F.lit(name))
    return out.otherwise("unknown")


def retry_wait(category: Column, attempt: Column) -> Column:
    """Seconds before the next attempt, without the jitter of rate limits; null where none is made."""
    return (
        F.when(category == "network", F.least(F.lit(60.0), 5 * F.pow(F.lit(2.0), attempt)))
        .when(category == "timeout", F.least(F.lit(60.0), 10.0 * (attempt + 1)))
        .when(category == "browser", 5.0 * (attempt + 1))
        .when(category == "rate_limit", F.least(F.lit(300.0), 60.0 * (attempt + 1)))
    )


def retryable(category: Column) -> Column:
    return category.isin(RETRYABLE)


def block_phrase(c: Column, platform: str) -> Column:
    """The first phrase of a platform's list that the text holds."""
    return F.coalesce(*[F.when(F.contains(F.lower(c), F.lit(p)), F.lit(p)) for p in BLOCK_PHRASES[platform]])


def blocked(url: Column, text: Column, platform: str) -> Column:
    """Whether a page's URL or text says that the platform blocks."""
    by_url = F.coalesce(*[F.when(F.contains(url, F.lit(p)), True) for p in BLOCK_URLS.get(platform, [])], F.lit(False))
    return by_url | (block_phrase(text, platform).isNotNull() if platform in BLOCK_PHRASES else F.lit(False))


def error_context(message: Column, attempt: Column, **parts: Column) -> Column:
    """An error with its category, whether another attempt may help, the wait before it, and what it was about."""
    category = error_category(message)
    return F.struct(message.alias("message"), category.alias("category"), retryable(category).alias("retryable"), retry_wait(category, attempt).alias("wait"), F.create_map(*[x for k, v in sorted(parts.items()) for x in (F.lit(k), v.cast("string"))]).alias("context") if parts else F.lit(None).cast("map<string,string>").alias("context"))


def fallback_id(url: Column) -> Column:
    """A stable number below 10 ** 10 for a URL without an id."""
    return F.pmod(F.xxhash64(url), F.lit(10_000_000_000)).cast("string")


#: Where post ids lie in URLs; the first pattern that matches counts.
POST_ID = {
    "facebook": [r"/posts/([0-9]+)", r"story_fbid=([0-9]+)", r"/photos/[^/]+/([0-9]+)", r"(pfbid[a-zA-Z0-9]{20,35})", r"(pfbid[a-zA-Z0-9]{15,19})", r"/videos/([0-9]+)", r"/reel/([0-9]+)", r"[?&]v=([0-9]+)", r"/permalink/([0-9]+)"],
    "instagram": [r"/(?:p|reel|tv)/([^/]+)/"],
    "twitter": [r"/status/([0-9]+)"],
    "linkedin": [r"activity:([0-9]+)"],
    "google": [r"place_id:([^&/]+)", r"!1s([^!]+)"],
}


def url_post_id(c: Column, platform: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in POST_ID[platform]])


def url_in_scope(c: Column, page: Column | None = None) -> Column:
    """Whether a link is no group's or event's and, where a page is named, one of that page's own, in any case of letters."""
    ours = ~(F.contains(c, F.lit("/groups/")) | F.contains(c, F.lit("/events/")))
    if page is None:
        return ours
    low = F.lower(c)
    return ours & (page.isNull() | (page == "") | F.contains(low, F.concat(F.lit("/"), page, F.lit("/"))) | F.contains(low, F.concat(F.lit("facebook.com/"), page)))


def absolute_url(c: Column, base: str = "https://www.facebook.com") -> Column:
    """Links without a scheme belong to the base."""
    return F.when(F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit(base), c))


def cache_key(kind: Column, **parts: Column) -> Column:
    """``kind:k=v:...`` with sorted keys and without nulls."""
    return F.md5(F.concat_ws(":", kind, *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in sorted(parts.items())]))
