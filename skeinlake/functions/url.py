"""URL algebra as column expressions: parsing, normalisation, filters, globs and host rules.

Everything here stays inside the JVM. URLs are split by regular expressions rather than by
``parse_url``, which rejects spaces and bars and keeps dot segments. Nulls give nulls in every
function; malformed addresses give null parts.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# fixed values: query keys that only track visits, and extensions of static assets
TRACKING_KEYS = ("utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid msclkid mc_eid ref ref_src igshid yclid").split()
ASSET_EXTENSIONS = (
    "jpg jpeg png gif webp svg ico bmp tiff mp4 webm mp3 wav ogg zip rar 7z tar gz woff woff2 ttf eot css js map pdf docx xlsx pptx exe dmg pkg deb rpm iso"
).split()
IGNORED_SCHEMES = "javascript mailto tel data sms callto fax magnet".split()

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*?))?\s*$"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def scheme(url: Column) -> Column:
    """Scheme in lower case; null where the address has none."""
    return F.nullif(F.lower(_part(url, 1)), F.lit(""))


def host(url: Column) -> Column:
    """Host in lower case without port; null where there is none."""
    return F.nullif(F.lower(_part(url, 2)), F.lit(""))


def path(url: Column) -> Column:
    """Path with dot segments resolved; ``/`` where it is empty, null for malformed addresses."""
    return let(_parts(url), lambda p: F.when(_sound(p), _path(p)))


def _parts(url: Column) -> Column:
    """Scheme, host, port, path and query by one scan; one element where the address is malformed."""
    return F.split(F.regexp_replace(url, _URL, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001", -1)


def _sound(p: Column) -> Column:
    return (F.size(p) == 5) & (F.element_at(p, 2) != "")


def _path(p: Column) -> Column:
    raw = F.element_at(p, 4)
    return F.when(raw == "", F.lit("/")).when(F.contains(raw, F.lit("/.")) | F.contains(F.lower(raw), F.lit("/%2e")) | ~F.startswith(raw, F.lit("/")), resolve_dots(raw)).otherwise(raw)


def _origin(p: Column) -> Column:
    s, port = F.lower(F.element_at(p, 1)), F.element_at(p, 3)
    default = (port == "") | (s == "http") & (port == "80") | (s == "https") & (port == "443")
    return F.concat(s, F.lit("://"), F.lower(F.element_at(p, 2)), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))


def resolve_dots(p: Column) -> Column:
    """Resolves ``.`` and ``..`` segments and makes the path absolute."""
    segments = F.split(F.regexp_replace(p, "^/", ""), "/")
    empty = F.array().cast("array<string>")

    def walk(parts):
        n = F.size(parts)
        numbered = F.transform(parts, lambda s, i: F.struct(s.alias("s"), (i == n - 1).alias("last")))

        def step(acc, x):
            up, here = F.lower(x["s"]).isin("..", "%2e%2e", ".%2e", "%2e."), F.lower(x["s"]).isin(".", "%2e")
            cut = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
            tail = F.when(x["last"], F.array(F.lit(""))).otherwise(empty)
            return F.when(up, F.concat(cut, tail)).when(here, F.concat(acc, tail)).otherwise(F.concat(acc, F.array(x["s"])))

        return F.concat(F.lit("/"), F.array_join(F.aggregate(numbered, empty, step), "/"))

    return let(segments, walk)


def origin(url: Column) -> Column:
    """``scheme://host[:port]`` without default ports."""
    return let(_parts(url), lambda p: F.when(_sound(p), _origin(p)))


def syntax_error(url: Column) -> Column:
    """Why an address is no web address: ``empty``, ``scheme``, ``host``, or null where it is fine."""
    t = F.lower(F.regexp_replace(url, r"^\s+|\s+$", ""))
    return (
        F.when(url.isNull() | (t == ""), F.lit("empty"))
        .when(t.rlike("^(?:javascript|data|file|ftp|mailto|tel|about):") | ~t.rlike("^https?:"), F.lit("scheme"))
        .when(host(url).isNull(), F.lit("host"))
    )


def is_ignorable(href: Column) -> Column:
    """Hrefs that lead to no page: script, mail and telephone schemes, or a bare ``#``."""
    t = F.lower(F.regexp_replace(href, r"^\s+|\s+$", ""))
    return t.rlike("^(?:" + "|".join(IGNORED_SCHEMES) + "):") | (t == "#")


def is_external(base: Column, target: Column) -> Column:
    """Whether hosts differ; an address without a host is external."""
    return ~F.coalesce(host(base) == host(target), F.lit(False))


def strip_default_port(url: Column) -> Column:
    """The address without a default port; its fragment stays."""
    rest = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*?)\s*$", 1)
    return F.when(host(url).isNotNull(), F.concat(origin(url), F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))))


def clean_query(query: Column, strip_tracking: bool = True) -> Column:
    """Query without tracking keys, sorted by key, the last value of a key kept; spaces become ``+``."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), F.regexp_extract(p, "^[^=]*=?(.*)$", 1).alias("v")))
    if strip_tracking:
        keyed = F.filter(keyed, lambda x: ~F.lower(x["k"]).isin(*TRACKING_KEYS))

    def join(xs):
        last = F.filter(xs, lambda x, i: F.coalesce(F.get(xs, i + 1)["k"] != x["k"], F.lit(True)))
        return F.array_join(F.transform(last, lambda x: F.concat(F.replace(x["k"], F.lit("%20"), F.lit("+")), F.lit("="), F.replace(x["v"], F.lit("%20"), F.lit("+")))), "&")

    return let(F.array_sort(keyed), join)


def normalize(url: Column, ignore_query: bool = False, strip_tracking: bool = True) -> Column:
    """Crawl form of an address: no fragment or default port, resolved path, cleaned and sorted query. A trailing slash stays."""

    def build(p):
        base, query = F.concat(_origin(p), _path(p)), F.element_at(p, 5)
        if not ignore_query:
            base = F.concat(base, F.when(query == "", F.lit("")).otherwise(let(clean_query(query, strip_tracking), lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))))
        return F.when(_sound(p), base)

    return let(_parts(url), build)


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(_part(url, 4), r"\.([^./]*)$", 1))


def is_static_asset(url: Column, document_types: list[str] = ()) -> Column:
    """Whether the path ends in an asset extension that no wanted document type allows."""
    allowed = {"plain_text": ["txt", "text", "md"], "feed": ["rss", "atom"]}
    keep = {e for t in document_types for e in allowed.get(t, [t])}
    return extension(url).isin(*[e for e in ASSET_EXTENSIONS if e not in keep])


def same_domain(seed: Column, target: Column, subdomains: bool = False) -> Column:
    """Equal hosts, or a host below the seed's where subdomains count."""
    a, b = host(seed), host(target)
    same = a == b
    return F.coalesce(same | b.endswith(F.concat(F.lit("."), a)) if subdomains else same, F.lit(False))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a path glob: ``**`` spans segments, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + ".*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.sub(r"([^\w/ ])", r"\\\1", pattern[i]), i + 1
    return f"(?s)^{out}$"


def path_allowed(p: Column, includes: list[str] = (), excludes: list[str] = ()) -> Column:
    """Excludes win; without includes all the rest passes; blank patterns count for nothing, but includes that are all blank deny."""
    full = F.when(F.substring(p, 1, 1) == "/", p).otherwise(F.concat(F.lit("/"), p))
    slash = lambda g: g.strip() if g.strip().startswith(("/", "*")) else "/" + g.strip()
    out = [glob_regex(slash(g)) for g in excludes if g.strip()]
    into = [glob_regex(slash(g)) for g in includes if g.strip()]
    denied = full.rlike("|".join(f"(?:{x})" for x in out)) if out else F.lit(False)
    wanted = (full.rlike("|".join(f"(?:{x})" for x in into)) if into else F.lit(False)) if includes else F.lit(True)
    return ~denied & wanted


def blocked_host(h: Column) -> Column:
    """Hosts a crawler must not reach: local names, private, reserved and special IPv4 ranges, IPv6 literals of such ranges."""

    def v4(octets):
        a, b, c = (F.element_at(octets, i).try_cast("int") for i in (1, 2, 3))
        return (
            a.isin(0, 10, 127) | (a >= 224) | (a == 100) & b.between(64, 127) | (a == 169) & (b == 254) | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168)
            | (a == 192) & (b == 0) & c.isin(0, 2) | (a == 198) & b.isin(18, 19) | (a == 198) & (b == 51) & (c == 100) | (a == 203) & (b == 0) & (c == 113)
        )

    def test(t):
        v6 = r"^\[(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*|::ffff:.*|64:ff9b:.*)\]$"
        names = r"^(?:localhost|local|instance-data)$|\.(?:localhost|local|internal)$"
        return F.when(t.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), v4(F.split(t, r"\."))).when(F.startswith(t, F.lit("[")), t.rlike(v6)).otherwise(t.rlike(names))

    return F.coalesce(let(F.lower(F.regexp_replace(h, r"^\s+|\s+$", "")), test), F.lit(False))


def filter_reason(url: Column, depth: Column, seed: Column, max_depth: int = 3, subdomains: bool = False, includes: list[str] = (), excludes: list[str] = (), document_types: list[str] = ()) -> Column:
    """First reason to leave an address out of a crawl, cheapest test first; null where it may be fetched."""
    return (
        F.when(F.coalesce(syntax_error(url).isNotNull(), F.lit(True)), F.lit("scheme"))
        .when(depth > max_depth, F.lit("depth"))
        .when(blocked_host(host(url)), F.lit("blocked_host"))
        .when(is_static_asset(url, document_types), F.lit("static_asset"))
        .when(~same_domain(seed, url, subdomains), F.lit("domain"))
        .when(~path_allowed(path(url), includes, excludes), F.lit("path"))
    )


# fixed values: host and path rules of source classes, first match wins, with the weight of each class
SOURCE_RULES = [
    ("government", r"\.gov$|\.gov\.uk$|\.mil$", None, 0.85),
    ("academic", r"\.edu$|\.ac\.uk$|arxiv\.org|doi\.org|biorxiv\.org|semanticscholar\.org|nature\.com|ieee\.org|acm\.org", None, 0.85),
    ("repository", r"^(?:github\.com|gitlab\.com|crates\.io|npmjs\.com|pypi\.org|pkg\.go\.dev|rubygems\.org)$", None, 0.85),
    ("documentation", r"^docs\.|readthedocs\.io|^developer\.|gitbook\.io", r"^/(?:doc|documentation|guide|api|reference)", 0.9),
    ("news", r"reuters\.com|bloomberg\.com|bbc\.com|techcrunch\.com|nytimes\.com|wsj\.com|theverge\.com|arstechnica\.com|zdnet\.com", None, 0.65),
    ("community", r"reddit\.com|news\.ycombinator\.com|stackoverflow\.com|stackexchange\.com|quora\.com|medium\.com|dev\.to|discord\.com", None, 0.5),
]


def source_class(url: Column) -> Column:
    """Class of a source by its host and path; ``unknown`` for malformed addresses, ``primary`` where no rule matches."""
    h, p = host(url), F.lower(path(url))
    out = F.when(h.isNull(), F.lit("unknown"))
    for name, hosts, paths, _ in SOURCE_RULES:
        out = out.when(h.rlike(hosts) | (p.rlike(paths) if paths else F.lit(False)), F.lit(name))
    return out.otherwise(F.lit("primary"))


def source_weight(name: Column) -> Column:
    weights = {n: w for n, _, _, w in SOURCE_RULES} | {"primary": 0.95, "official": 1.0, "unknown": 0.4}
    out = F.lit(0.4)
    for n, w in weights.items():
        out = F.when(name == n, F.lit(w)).otherwise(out)
    return out
