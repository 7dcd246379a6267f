"""Row-cleaning column expressions (phone, e-mail, URL, model JSON)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import JS_WS, col, js_trim

# Fixed values of the validation rules.
PHONE_PREFIXES = ("+221", "00221")
PHONE_PATTERN = r"^7[0-9]{8}$"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
ALERT_IMAGE_HOST = "res.cloudinary.com"
ALERT_IMAGE_PATH = "/shop/image-search/"
GENERATED_PREFIX = "shop/ai-generated/"


def normalize_phone(c) -> Column:
    """Trim; drop white space ( ) . -; strip +221 / 00221; keep ^7\\d{8}$."""
    p = F.regexp_replace(js_trim(c), r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
                                     r"\x{202F}\x{205F}\x{3000}\x{FEFF}().\-]", "")
    p = (F.when(p.startswith(PHONE_PREFIXES[0]), F.substring(p, 5, 1 << 30))
         .when(p.startswith(PHONE_PREFIXES[1]), F.substring(p, 6, 1 << 30))
         .otherwise(p))
    return F.when(p.rlike(PHONE_PATTERN), p)


def is_email(c) -> Column:
    """Minimal e-mail shape (JS \\s = Unicode white space)."""
    ws = JS_WS[1:-1]
    return F.coalesce(col(c).rlike(f"^[^{ws}@]+@[^{ws}@]+\\.[^{ws}@]+$"), F.lit(False))


def contact_type(c) -> Column:
    """C4: 'email' when the contact contains '@', else 'phone'."""
    return F.when(F.instr(col(c), "@") > 0, F.lit("email")).otherwise(F.lit("phone"))


# The URL standard's special schemes; ASCII characters that a path percent-encodes.
SPECIAL_SCHEMES = ("http", "https", "ws", "wss", "ftp")
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_PATH_ENCODED = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60", "{": "%7B", "}": "%7D", "^": "%5E"}


def clean_url(c) -> Column:
    """A URL as a browser reads it: control characters and blanks at the ends, tabs and line breaks anywhere dropped."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def resolve_path(path: Column) -> Column:
    """The path after its dot segments: '.' and '%2e' vanish, '..' (also with '%2e') takes the segment before it.

    A left fold over the segments with the resolved path so far; a dot
    segment at the end leaves the folder ('/').
    """
    segs = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    dots = F.transform(segs, lambda x: F.regexp_replace(x, "(?i)%2e", "."))
    one, two = F.lit("."), F.lit("..")
    pairs = F.arrays_zip(segs.alias("raw"), dots.alias("dot"))
    out = F.aggregate(pairs, F.lit(""), lambda acc, x: F.when(x["dot"] == two, F.regexp_replace(acc, "/[^/]*$", ""))
                      .when(x["dot"] == one, acc).otherwise(F.concat(acc, F.lit("/"), x["raw"])))
    last = F.element_at(dots, -1)
    return F.when(F.size(segs) <= 0, F.lit("/")).otherwise(F.concat(out, F.when(last.isin(".", ".."), "/").otherwise("")))


def _encode_path(path: Column) -> Column:
    for c, e in _PATH_ENCODED.items():
        path = F.replace(path, F.lit(c), F.lit(e))
    wide = F.array_join(F.transform(F.split(path, ""), lambda x: F.when(x.rlike(r"^[^\x00-\x7F]"), F.url_encode(x)).otherwise(x)), "")
    return F.when(path.rlike(r"[^\x00-\x7F]"), wide).otherwise(path)


def url_parts(c) -> dict[str, Column]:
    """Protocol (with ':'), host and path of an absolute URL as the URL standard parses it; NULL on rubbish.

    Special schemes: backslashes are slashes, any number of slashes opens the
    host, user and password go, the host is lower-cased and percent-decoded, an
    impossible port refuses the URL, the path's dot segments are resolved.
    Other schemes keep their path as it is and have a host only after '//'.
    """
    u = clean_url(c)
    scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
    rest = F.regexp_replace(u, _SCHEME, "")
    special = scheme.isin(*SPECIAL_SCHEMES)
    flat = F.regexp_extract(rest, r"^([^?#]*)", 1)
    flat = F.when(special, F.translate(flat, "\\", "/")).otherwise(flat)
    opened = F.when(special, F.concat(F.lit("//"), F.regexp_replace(flat, "^/+", ""))).otherwise(flat)
    authority = F.regexp_extract(opened, "^//([^/]*)", 1)
    hostport = F.regexp_replace(authority, "^.*@", "")
    port = F.regexp_extract(hostport, r":([0-9]*)$", 1)
    host = F.lower(F.regexp_replace(hostport, r":[0-9]*$", ""))
    host = F.when(special & host.contains("%"), F.lower(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))))).otherwise(host)
    good = (scheme != "") & F.when(special, (host != "") & ~host.rlike(r"[\x00-\x20#%/:<>?@\[\\\]^|]")
                                   & (F.coalesce(F.nullif(port, F.lit("")).try_cast("bigint"), F.lit(0)) <= 65535)).otherwise(F.lit(True))
    raw = F.regexp_replace(opened, "^//[^/]*", "")
    path = F.when(special, _encode_path(resolve_path(raw))).otherwise(raw)
    return {"protocol": F.when(good, F.concat(scheme, F.lit(":"))), "host": F.when(good, host), "path": F.when(good, path)}


def url_allowed(c, host: str = ALERT_IMAGE_HOST, path_part: str = ALERT_IMAGE_PATH) -> Column:
    """Https, exact host, resolved path containing ``path_part``."""
    p = url_parts(c)
    return F.coalesce((p["protocol"] == F.lit("https:")) & (p["host"] == F.lit(host))
                      & (F.instr(p["path"], path_part) > 0), F.lit(False))


def generated_image_allowed(url, public_id, host: str = ALERT_IMAGE_HOST, id_prefix: str = GENERATED_PREFIX) -> Column:
    """C5, second rule (offers created with generated images): https, exact host, and a public id under
    ``id_prefix`` without '..'; url and public id given."""
    p = url_parts(url)
    pid = F.coalesce(col(public_id), F.lit(""))
    return F.coalesce((p["protocol"] == F.lit("https:")) & (p["host"] == F.lit(host)) & pid.startswith(id_prefix)
                      & (F.instr(pid, "..") == 0) & (F.coalesce(col(url), F.lit("")) != ""), F.lit(False))


def strip_fences(c) -> Column:
    """C10 step 1: drop ```json (any case) and ``` fences, then JS trim."""
    s = F.regexp_replace(col(c), r"(?i)```json", "")
    s = F.regexp_replace(s, "```", "")
    return js_trim(s)


def word_count(c) -> Column:
    """C11: ``text.trim().split(/\\s+/).length`` ('' counts one word): the runs of other characters, one at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(col(c), f"{JS_WS}+"), lambda w: w != F.lit(""))))


def js_number(v, kind) -> Column:
    """``Number(x) || 0`` of a JSON value given as text and JSON type: booleans are 0 or 1, blank texts 0,
    texts with anything but a number 0, null, lists and objects 0."""
    t = js_trim(v)
    text = F.when(t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    return F.coalesce(F.when(col(kind) == "boolean", F.when(col(v) == "true", 1.0).otherwise(0.0))
                      .when(col(kind).isin("string", "number"), text), F.lit(0.0))


def clamp01(v: Column) -> Column:
    """C11: max(0, min(1, x))."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
