"""Paths, names, addresses and parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Look-alike characters that weak recognition confuses.
LOOK_ALIKES = ("bghnuvzBDZ", "6qbrvu2802")


def file_side(name: Column, suffix: str) -> Column:
    """The client id of a file name that ends with the side's suffix and a known extension; null otherwise."""
    if not suffix.strip():
        raise ValueError("a side needs a suffix")
    return F.nullif(F.regexp_extract(name, rf"(?i)^(.+)\Q{suffix}\E\.(?:pdf|png|jpg|jpeg)$", 1), F.lit(""))


def find_side(names: Column, side: str) -> Column:
    """The first document name that marks the side, whatever its case and separators."""
    flat = lambda x: F.regexp_replace(F.lower(x), "[- ]", "_")
    return F.try_element_at(F.filter(names, lambda x: F.contains(flat(x), F.lit(f"cin_{side}"))), F.lit(1))


def safe_name(value: Column) -> Column:
    """A name fit for a file: other characters become one underscore, dots and underscores at the ends go."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(clean == "", "unknown").otherwise(clean)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def query_pairs(url: Column) -> Column:
    """name and value of every parameter of an address, in order, blanks and repeats kept."""
    decoded = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit(" ")))
    pairs = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda x: x != "")
    return F.transform(pairs, lambda x: F.struct(decoded(F.split_part(x, F.lit("="), F.lit(1))).alias("name"), decoded(F.substring(x, F.length(F.split_part(x, F.lit("="), F.lit(1))) + 2, F.length(x))).alias("value")))


def join_url(base: Column, endpoint: Column) -> Column:
    """Base and endpoint with one slash between them."""
    return F.concat(F.regexp_replace(F.trim(base), "/+$", ""), F.lit("/"), F.regexp_replace(F.trim(endpoint), "^/+", ""))


def enabled_pairs(rows: Column) -> Column:
    """The ticked parameters that have a name; null values become empty."""
    some = F.filter(rows, lambda r: r["enabled"] & (F.trim(F.coalesce(r["name"], F.lit(""))) != ""))
    return F.transform(some, lambda r: F.struct(F.trim(r["name"]).alias("name"), F.coalesce(r["value"], F.lit("")).alias("value")))


def replace_pair(pairs: Column, name: str, value: Column) -> Column:
    """The parameter's value in its place, whatever the case of its name; at the end if it is not there."""
    own = lambda p: F.lower(p["name"]) == name.lower()
    there = F.transform(pairs, lambda p: F.when(own(p), F.struct(p["name"].alias("name"), value.alias("value"))).otherwise(p))
    return F.when(F.exists(pairs, own), there).otherwise(F.concat(pairs, F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))))


def mask_password(url: Column) -> Column:
    """Three stars in place of a password; empty where it is no address."""
    clean = F.trim(F.coalesce(url, F.lit("")))
    return F.when(clean.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]+"), F.regexp_replace(clean, "^([A-Za-z][A-Za-z0-9+.-]*://[^:@/]*):[^@/]*@([^/?#]+).*$", "$1:***@$2")).otherwise("")


def proxy_map(setting: Column) -> Column:
    """Proxy by protocol from a shared address or protocol=address;... pairs; null if there is none."""
    raw = F.trim(F.coalesce(setting, F.lit("")))
    full = lambda a: F.when(F.contains(a, F.lit("://")), a).otherwise(F.concat(F.lit("http://"), a))
    items = F.transform(F.split(raw, ";"), lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit("="), F.lit(1)))).alias("p"), F.trim(F.substring(x, F.instr(x, F.lit("=")) + 1, F.length(x))).alias("a"), F.contains(x, F.lit("=")).alias("ok")))
    some = F.filter(items, lambda i: i["ok"] & i["p"].isin("http", "https") & (i["a"] != ""))
    own = F.map_from_entries(F.transform(some, lambda i: F.struct(i["p"], full(i["a"]))))
    shared = F.create_map(F.lit("http"), full(raw), F.lit("https"), full(raw))
    return F.when(raw == "", F.lit(None)).when(~F.contains(raw, F.lit("=")), shared).otherwise(F.when(F.size(some) > 0, own))


def route(template: Column, client: Column) -> Column:
    """The template with the encoded client id."""
    return F.replace(template, F.lit("{client_id}"), F.replace(F.url_encode(client), F.lit("+"), F.lit("%20")))


def model_spec(spec: Column) -> tuple[Column, Column]:
    """Provider and model name of a specification; without a provider its name tells."""
    has = F.contains(spec, F.lit(":"))
    known = F.when(spec.startswith("Mock"), "mock").when(spec == "EasyOCR-Local", "easyocr").otherwise("ollama")
    plain = known.isin("mock", "easyocr")
    provider = F.when(plain, known).when(has & F.split_part(spec, F.lit(":"), F.lit(1)).isin("mock", "easyocr", "ollama"), F.split_part(spec, F.lit(":"), F.lit(1))).otherwise("ollama")
    name = F.when(~plain & has & F.split_part(spec, F.lit(":"), F.lit(1)).isin("mock", "easyocr", "ollama"), F.substring(spec, F.instr(spec, F.lit(":")) + 1, F.length(spec))).otherwise(spec)
    return provider, name


def corrupted(text: Column, key: Column, model: Column, percent: Column) -> Column:
    """A repeatable imitation of weak recognition: words drop at half the rate, look-alikes replace letters at the rate."""
    words = F.transform(F.split(text, r"\s+"), lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i")))
    left = F.filter(words, lambda s: F.pmod(key * 31 + s["i"] * 17 + model * 7, F.lit(100)) >= percent / 2)
    return F.array_join(F.transform(left, lambda s: F.when(F.pmod(key * 13 + s["i"] * 29 + model * 11, F.lit(100)) < percent, F.translate(s["w"], *LOOK_ALIKES)).otherwise(s["w"])), " ")


def markdown_table(header: list[str], rows: Column) -> Column:
    """A pipe table from an array of arrays of strings."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = f"| {' | '.join(header)} |\n| {' | '.join(['---'] * len(header))} |"
    return F.concat(F.lit(head + "\n"), F.array_join(F.transform(rows, line), "\n"))


def human_size(size: Column) -> Column:
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" o"))).when(size < 1 << 20, F.format_string("%.1f KiB", size / 1024.0)).otherwise(F.format_string("%.2f MiB", size / float(1 << 20)))


def extension_of(content_type: Column) -> Column:
    """The file extension of a supported content type, null otherwise."""
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.when(kind == "application/pdf", ".pdf").when(kind.isin("image/jpeg", "image/jpg"), ".jpg").when(kind == "image/png", ".png")


def address_scope(address: Column) -> Column:
    """loopback, private, link-local, global or special, of an IPv4 address; null if it is none."""
    shape = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    a, b, c, d = (F.regexp_extract(address, shape, i).try_cast("int") for i in (1, 2, 3, 4))
    good = address.rlike(shape) & (F.greatest(a, b, c, d) <= 255)
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 0) | (a >= 240) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    special = ((a == 100) & b.between(64, 127)) | a.between(224, 239)
    return F.when(good, F.when(a == 127, "loopback").when((a == 169) & (b == 254), "link-local").when(private, "private").when(special, "special").otherwise("global"))
