"""Scalar functions over response records, as SQL expressions that Catalyst compiles: channels, partition keys, parsing and scope rules.

Each function gives the text of an expression; `F.expr` makes it a column. Where engines name a function differently, `names` holds the name in question, so that
the same definition can be checked on another engine.
"""

from __future__ import annotations

#: Status codes, content classes, size buckets and word extensions that have a channel of their own.
STATUS_EXACT = (200, 204, 301, 302, 307, 401, 403, 404, 405, 500)
STATUS_EXTRA = (206, 303, 304, 400, 409, 410, 429, 502, 503, 504)
CONTENT_CLASSES = ("html", "json", "xml", "text", "script", "image", "binary", "none", "other")
BUCKETS = (("empty", 0, 1), ("tiny", 1, 256), ("small", 256, 4096), ("medium", 4096, 65536), ("large", 65536, 1048576), ("huge", 1048576, None))
EXTENSIONS = {"php": ("php", "phtml", "php5", "asp", "aspx", "jsp"), "markup": ("html", "htm", "xml", "xhtml"), "data": ("json", "csv", "yaml", "yml", "txt"), "archive": ("bak", "old", "zip", "tar", "gz", "sql", "swp")}
#: Floors of the z channels: (value, relative floor, absolute floor).
Z_FLOORS = {"length": (0.02, 2.0), "words": (0.02, 1.0), "lines": (0.02, 1.0), "duration": (0.5, 2.0)}

SPARK = {"segments": "filter(split(translate({0}, chr(92), '/'), '[/]'), x -> x <> '')", "both": "size(array_intersect({0}, {1}))", "either": "size(array_union({0}, {1}))", "some": "size({0})", "without": "regexp_replace({0}, r'{1}', '')", "entropy": "aggregate(array_distinct(filter(split({0}, ''), x -> x <> '')), cast(0 as double), (a, x) -> a - (size(filter(split({0}, ''), y -> y = x)) / length({0})) * log2(size(filter(split({0}, ''), y -> y = x)) / length({0})))"}


def clamp(x: str) -> str:
    return f"least(greatest(cast({x} as double), cast(0 as double)), cast(1 as double))"


def log_scaled(x: str, ceiling: float) -> str:
    return clamp(f"ln(1 + cast(greatest({x}, 0) as double)) / ln(cast({1 + ceiling} as double))")


def flag(condition: str) -> str:
    return f"(case when {condition} then cast(1 as double) else cast(0 as double) end)"


def floored_z(x: str, n: str, total: str, squares: str, relative: float, absolute: float, unit: float = 1.0) -> str:
    """0.5 + deviation over 8 floored standard deviations, held in [0, 1]; 0.5 for fewer than two values before. Sums are exact integers in 1/unit."""
    n_, s, ss = (f"cast({c} as double)" for c in (n, total, squares))
    mean = f"({s} / {n_} / {unit})"
    std = f"sqrt(greatest(({n_} * {ss} - {s} * {s}) / ({n_} * ({n_} - 1)), cast(0 as double))) / {unit}"
    scale = f"greatest({std}, cast({relative} as double) * abs({mean}), cast({absolute} as double))"
    return f"(case when {n} < 2 then cast(0.5 as double) else {clamp(f'0.5 + (cast({x} as double) - {mean}) / ({scale} * 8)')} end)"


def min_max(x: str, n: str, low: str, high: str) -> str:
    return f"(case when {n} = 0 or {n} is null or {high} <= {low} then cast(0.5 as double) else {clamp(f'(cast({x} as double) - {low}) / ({high} - {low})')} end)"


def content_class(column: str = "content_type") -> str:
    c = f"lower(trim(split_part({column}, ';', 1)))"
    return (
        f"(case when {c} = '' then 'none' when contains({c}, 'html') then 'html' when contains({c}, 'json') then 'json' when contains({c}, 'xml') then 'xml' "
        f"when left({c}, 6) = 'image/' then 'image' when left({c}, 5) = 'text/' then 'text' when contains({c}, 'javascript') or contains({c}, 'ecmascript') then 'script' "
        f"when contains({c}, 'octet-stream') or left({c}, 12) = 'application/' then 'binary' else 'other' end)"
    )


def netloc(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"


def path_of(url: str) -> str:
    """The path of an address, tolerant of characters that strict parsers refuse; '/' if there is none."""
    p = f"regexp_extract({url}, '^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)', 1)"
    return f"(case when {p} = '' then '/' else {p} end)"


def slashed(x: str) -> str:
    """With slashes for backslashes: both part segments."""
    return f"translate({x}, chr(92), '/')"


def overlap(a: str, b: str, names: dict = SPARK) -> str:
    x, y = names["segments"].format(a), names["segments"].format(b)
    return f"(case when {names['some'].format(x)} = 0 or {names['some'].format(y)} = 0 then cast(0 as double) else cast({names['both'].format(x, y)} as double) / {names['either'].format(x, y)} end)"


def extension(word: str = "word") -> str:
    """The last segment's extension in lower case, if a dot stands after its first character."""
    return f"lower(regexp_extract({slashed(word)}, '[^/][^/]*[.]([^./]*)$', 1))"


def fraction(text: str, pattern: str, names: dict = SPARK) -> str:
    """Share of the characters that match a class."""
    without = names["without"].format(text, pattern)
    return f"(case when length({text}) = 0 then cast(0 as double) else cast(length({text}) - length({without}) as double) / length({text}) end)"


def size_channels() -> dict[str, str]:
    out = {f"size.log_{c}": log_scaled(c, x) for c, x in (("length", 1e6), ("words", 1e5), ("lines", 1e4))}
    return out | {f"size.{c}_z": floored_z(c, "n", f"s_{c}", f"q_{c}", *Z_FLOORS[c]) for c in ("length", "words", "lines")}


def ratio_channels() -> dict[str, str]:
    return {f"ratio.{name}": log_scaled(f"cast({a} as double) / greatest({b}, 1)", x) for name, a, b, x in (("bytes_per_word", "length", "words", 1e3), ("words_per_line", "words", "lines", 1e3), ("bytes_per_line", "length", "lines", 1e4))}


def status_channels(extra: bool = False) -> dict[str, str]:
    codes = ", ".join(map(str, STATUS_EXACT))
    out = {f"status.{k}xx": flag(f"floor(status / 100) = {k}") for k in (2, 3, 4, 5)} | {f"status.{k}": flag(f"status = {k}") for k in STATUS_EXACT}
    out["status.uncommon"] = flag(f"status not in ({codes}) and status <> 0")
    return out | ({f"status.{k}": flag(f"status = {k}") for k in STATUS_EXTRA} if extra else {})


def content_channels() -> dict[str, str]:
    return {f"ctype.{k}": flag(f"{content_class()} = '{k}'") for k in CONTENT_CLASSES}


def redirect_channels(names: dict = SPARK) -> dict[str, str]:
    r = "redirect_location"
    return {
        "redir.present": flag(f"{r} <> ''"), "redir.same_host": flag(f"{r} <> '' and ({netloc(r)} = '' or {netloc(r)} = {netloc('url')})"),
        "redir.path_similarity": f"(case when {r} = '' then cast(0 as double) else {overlap(path_of('url'), path_of(r), names)} end)", "redir.log_length": log_scaled(f"length({r})", 512),
    }


def time_channels() -> dict[str, str]:
    return {"time.z": floored_z("duration_ms", "n", "s_duration", "q_duration", *Z_FLOORS["duration"], unit=1000.0), "time.log": log_scaled("duration_ms", 3e4)}


def word_channels(names: dict = SPARK) -> dict[str, str]:
    ext = extension()
    known = ", ".join(f"'{x}'" for xs in EXTENSIONS.values() for x in xs)
    out = {"word.log_length": log_scaled("length(word)", 64), "word.depth": clamp(f"(length(word) - length(replace({slashed('word')}, '/', ''))) / 6.0"), "word.has_extension": flag(f"{ext} <> ''"), "word.digit_fraction": fraction("word", r"\p{Nd}", names), "word.upper_fraction": fraction("word", r"\p{Lu}", names), "word.punct_fraction": fraction(slashed("word"), r"[^\p{L}\p{N}/]", names), "word.entropy": clamp(names["entropy"].format("word") + " / 6.0")}
    for name, members in EXTENSIONS.items():
        out[f"word.ext_{name}"] = flag(f"{ext} in ({', '.join(repr(m) for m in members)})")
    return out | {"word.ext_other": flag(f"{ext} <> '' and {ext} not in ({known})")}


def bucket_channels() -> dict[str, str]:
    return {f"size.{name}": flag(f"length >= {low}" + (f" and length < {high}" if high else "")) for name, low, high in BUCKETS}


def raw_channels() -> dict[str, str]:
    out = {f"raw.{c}": min_max(c, "n", f"lo_{c}", f"hi_{c}") for c in ("length", "words", "lines")} | {"raw.duration": min_max("duration_ms", "n", "lo_duration", "hi_duration")}
    out |= {"raw.status": clamp("status / 600.0"), "raw.has_redirect": flag("redirect_location <> ''"), "raw.word_length": clamp("length(word) / 32.0")}
    return out | {f"raw.status_{k}xx": flag(f"floor(status / 100) = {k}") for k in (2, 3, 4, 5)}


def channel_set(version: str, names: dict = SPARK) -> dict[str, str]:
    """Channels by name, in order: v1-raw, v3-response (the default) or v4-glomerular; v2-log adds the word channels and length per input character."""
    if version == "v1-raw":
        return raw_channels()
    v3 = size_channels() | ratio_channels() | status_channels() | content_channels() | redirect_channels(names) | time_channels()
    if version == "v3-response":
        return v3
    if version == "v2-log":
        return v3 | {"ratio.length_per_input_char": log_scaled("cast(length as double) / greatest(length(word), 1)", 1e4)} | word_channels(names)
    if version == "v4-glomerular":
        return v3 | status_channels(extra=True) | bucket_channels()
    raise ValueError(f"unknown channel set {version!r}")


def key(how: str) -> str:
    """The partition key: none, host, dir (host and base, the word taken off) or shape (host, status, power of two of the length)."""
    host = f"(case when host <> '' then host else {netloc('url')} end)"
    if how == "none":
        return "''"
    if how == "host":
        return host
    if how == "dir":
        base = f"(case when word <> '' and right(url, length(word)) = word then left(url, length(url) - length(word)) else {path_of('url')} end)"
        return f"concat({host}, regexp_extract({path_of(base)}, '^(.*/)', 1))"
    if how == "shape":
        return f"concat({host}, '|', cast(status as varchar(20)), '|', cast((case when length > 0 then length(bin(cast(length as bigint))) - 1 else -1 end) as varchar(20)))"
    raise ValueError(f"unknown partition {how!r}")


#: The refusals of a scope pattern, in order, as (reason, condition on `p`, the trimmed pattern in lower case).
REFUSALS = (
    ("empty", "p = ''"), ("url", "left(p, 7) = 'http://' or left(p, 8) = 'https://' or left(p, 2) = '//'"), ("cidr", "regexp_extract(p, '/[0-9]{1,3}$', 0) <> ''"), ("path", "contains(p, '/')"), ("comma", "contains(p, ',')"),
    ("whitespace", "regexp_extract(p, '[ \t]', 0) <> ''"), ("placeholder", "regexp_extract(p, '[{}<>()]', 0) <> '' or contains(p, '[') or contains(p, ']')"), ("inner wildcard", "contains(p, '*') and left(p, 2) <> '*.'"), ("several wildcards", "length(p) - length(replace(p, '*', '')) > 1"),
    ("not a host", "regexp_extract(p, '^([*][.])?[a-z0-9]([a-z0-9.-]*[a-z0-9])?(:[0-9]+)?$', 0) = ''"),
)


def refusal() -> str:
    return "(case " + " ".join(f"when {condition} then '{reason}'" for reason, condition in REFUSALS) + " else '' end)"


#: The bands of a score.
BANDS = "(case when novelty >= 0.8 then 'unseen' when novelty >= 0.5 then 'mostly-new' when novelty >= 0.2 then 'part-new' else 'trace' end)"
