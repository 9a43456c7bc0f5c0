"""Structured model answers: finding the JSON object, reading a side, merging two sides, comparing with labels."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import measures

# The default fields of the two sides, the fields that are compared, the answer's field a label's field is
# compared with where the names differ, and the interface's field that a label's field comes from.
RECTO = ("cin", "prenom", "nom", "date_naissance", "ville_naissance", "date_validite")
VERSO = ("cin", "date_validite", "adresse")
LABEL_FIELDS = ("cin", "prenom", "nom", "date_naissance", "ville_naissance", "date_validite", "adresse")
ALIASES = {"cin": "cin_fusionne", "date_validite": "date_validite_fusionnee"}
INTERFACE = {"cin": "cin_id", "prenom": "first_name", "nom": "last_name", "date_naissance": "birth_date", "ville_naissance": "birth_place", "date_validite": "validity_date", "adresse": "address"}
CUSTOMER = "$.response.body.response_data.customer"
PREVIEW = 50_000


def json_object(answer: Column) -> Column:
    """From the first { to the last } of the answer, Markdown fence or not; null if there is none."""
    return F.nullif(F.regexp_extract(F.trim(F.coalesce(answer, F.lit(""))), r"(?s)\{.*\}", 0), F.lit(""))


def with_parsed(rows: DataFrame, answer: str, name: str = "parsed") -> DataFrame:
    """The rows with the answer's object, parsed once, and why it can't be read in ``<name>_error``.

    What reads fields takes the parsed column, which the optimiser keeps as a
    projection of its own as it is read more than once.
    """
    found = rows.withColumn(f"{name}_object", json_object(F.col(answer)))
    read = found.withColumn(name, F.try_parse_json(f"{name}_object"))
    error = F.when(F.col(f"{name}_object").isNull(), "model_response_not_json").when(F.col(name).isNull(), "model_response_invalid_json")
    return read.withColumn(f"{name}_error", error).drop(f"{name}_object")


def scalar(value: Column, path: str) -> Column:
    """A string, number or truth value as trimmed text; null if blank, absent, an object or an array."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    own = F.trim(F.try_variant_get(value, path, "string"))
    own = F.when(kind == "BOOLEAN", F.initcap(own)).otherwise(own)
    return F.when(~kind.rlike("^(OBJECT|ARRAY)"), F.nullif(own, F.lit("")))


def side(value: Column, keys: tuple[str, ...], under: str | None = None) -> Column:
    """The configured fields of a side of a parsed answer; unknown keys go, missing ones are null."""
    root = f"$.{under}" if under else "$"
    return F.struct(*[scalar(value, f"{root}.{k}").alias(k) for k in keys])


def plain(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def merged(recto: Column, verso: Column) -> tuple[Column, Column]:
    """The value both sides agree on, and whether they do: null with one side only."""
    both = recto.isNotNull() & verso.isNotNull()
    same = plain(recto) == plain(verso)
    return F.when(both, F.when(same, recto)).otherwise(F.coalesce(recto, verso)), F.when(both, same)


def global_record(recto: Column, verso: Column, client: dict[str, Column] | None = None) -> dict[str, Column]:
    """The fields of both sides in one record, behind the client's own: folder, documents, label state, sides."""
    cin, cin_same = merged(recto["cin"], verso["cin"])
    valid, valid_same = merged(recto["date_validite"], verso["date_validite"])
    own = {n: (client or {}).get(n, F.lit(None).cast("string")) for n in ("folder_client_id", "recto_document_id", "verso_document_id", "label_status")}
    return own | {
        "recto": recto, "verso": verso,
        "cin_recto": recto["cin"], "cin_verso": verso["cin"], "cin_fusionne": cin, "cin_coherent": cin_same,
        "nom": recto["nom"], "prenom": recto["prenom"], "date_naissance": recto["date_naissance"], "ville_naissance": recto["ville_naissance"],
        "date_validite_recto": recto["date_validite"], "date_validite_verso": verso["date_validite"],
        "date_validite_fusionnee": valid, "date_validite_coherente": valid_same, "adresse": verso["adresse"],
    }


#: Letters whose case folding holds ASCII letters and differs from lower case: one letter each, then two or three.
FOLDED_ONE = ("ſŉǰẖẗẘẙẚ", "snjhtwya")
FOLDED_MORE = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def bare(value: Column) -> Column:
    """What two values are compared by: the ASCII letters and digits of the case-folded text."""
    folded = F.translate(F.lower(value), *FOLDED_ONE)
    for letter, letters in FOLDED_MORE.items():
        folded = F.replace(folded, F.lit(letter), F.lit(letters))
    return F.regexp_replace(F.when(value.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(value)), "[^a-z0-9]", "")


def compared(expected: Column, actual: Column) -> Column:
    """label_missing, missing_model, correct or different; case and what is no ASCII letter or digit don't count."""
    empty = lambda c: c.isNull() | (c == "")
    return F.when(empty(expected), "label_missing").when(empty(actual), "missing_model").when(bare(expected) == bare(actual), "correct").otherwise("different")


def expected(label: Column, field: str) -> Column:
    """A label's value of a field: its own, or where that is absent or null, that of the first side which names the field."""
    def text(path: str) -> Column:
        value = F.try_variant_get(label, path, "variant")
        return F.when(~F.is_variant_null(value), F.coalesce(F.try_variant_get(label, path, "string"), F.to_json(value)))

    there = lambda path: F.try_variant_get(label, path, "variant").isNotNull()
    recto, verso = f"$.recto.{field}", f"$.verso.{field}"
    return F.coalesce(text(f"$.{field}"), F.when(there(recto), text(recto)).otherwise(text(verso)))


def comparisons(label: Column, record: dict[str, Column]) -> dict[str, Column]:
    """The verdict on each field of LABEL_FIELDS of a parsed label; without a label all are missing there, without a record in the model."""
    return {f: compared(expected(label, f), record[ALIASES.get(f, f)]) for f in LABEL_FIELDS}


def confidence_rows(rows: DataFrame, keys: list[str], comparison: str, confidence: str) -> DataFrame:
    """A row for each field with a confidence: the field, its verdict (a dash if there is none) and the confidence. Both columns are maps by field."""
    some = rows.select(*keys, F.col(comparison).alias("verdicts_"), F.explode(confidence).alias("field", "confidence")).where("confidence is not null")
    return some.select(*keys, "field", F.coalesce(F.try_element_at("verdicts_", F.col("field")), F.lit("—")).alias("comparison"), F.col("confidence").cast("double").alias("confidence"))


def customer_label(payload: Column, source: str = "customer_data") -> dict[str, Column]:
    """The label in a parsed customer payload: seven fields, dates as Y-m-d, confidences by field where they are given, the customer's id and the source."""
    data = f"{CUSTOMER}.customer_data"
    clean = lambda name: F.nullif(F.trim(F.try_variant_get(payload, f"{data}.{name}", "string")), F.lit(""))
    fields = {f: measures.iso_date(clean(n)) if "date_" in f else clean(n) for f, n in INTERFACE.items()}
    given = F.create_map(*[x for f, n in INTERFACE.items() for x in (F.lit(f), F.try_variant_get(payload, f"{data}.{n}_confidence", "double"))])
    return fields | {
        "field_confidence": F.map_filter(given, lambda k, v: v.isNotNull()),
        "label_source": F.lit(source),
        "customer_id": F.try_variant_get(payload, f"{CUSTOMER}.id", "string"),
    }


def strip_fence(answer: Column) -> Column:
    """Without a Markdown fence that is bare or says markdown, html or text."""
    return F.trim(F.regexp_replace(F.trim(answer), r"(?is)^```[ \t]*(?:markdown|html|text)?[ \t]*\n(.*?)\n?```$", "$1"))


def preview(trace: Column, most: int = PREVIEW) -> Column:
    """At most so many characters of a trace, with a notice where more are left out."""
    return F.when(F.length(trace) > most, F.concat(F.left(trace, F.lit(most)), F.lit(f"\n[{most} characters shown]"))).otherwise(trace)


def parameters(text: Column) -> Column:
    """Extra parameters from a JSON object: null values are left out, empty ones stay; null if it is no object."""
    return F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: v.isNotNull())


#: What a model is told besides the fields: where values stand and what is not to be read.
RULES = (
    "Copy only what is printed in Latin letters, as it is spelled; add, translate and guess nothing.",
    "prenom is the first name of the holder, nom the family name; names of parents are neither.",
    "Of several dates take the one at the field's own label, and write a legible one as YYYY-MM-DD.",
    "Leave out codes, machine-readable lines and register numbers. Write null for what can't be read.",
    "Answer with one JSON object of the form below and nothing else, without a fence.",
)


def _asked(head: str, form: str, instructions: Column, most: int) -> Column:
    more = F.nullif(F.trim(instructions), F.lit(""))
    fixed = "\n".join([head, *RULES, form])
    return F.concat(F.lit(fixed), F.coalesce(F.concat(F.lit("\nMore instructions, which don't change the form:\n"), F.left(more, F.lit(most))), F.lit("")))


def prompt(side_name: str, fields: dict[str, tuple[str, ...]], instructions: Column, most: int = 4000) -> Column:
    """The question for one side: rules, its fields as a JSON object of nulls, bounded instructions."""
    if side_name not in ("recto", "verso"):
        raise ValueError("a side is recto or verso")
    return _asked(f"Read the {side_name} side of this identity card.", json.dumps(dict.fromkeys(fields[side_name])), instructions, most)


def combined_prompt(fields: dict[str, tuple[str, ...]], instructions: Column, most: int = 4000) -> Column:
    """The question for an image with the recto side above the verso side."""
    form = json.dumps({s: dict.fromkeys(fields[s]) for s in ("recto", "verso")})
    return _asked("This image has the recto side of an identity card above its verso side. Read both, each for itself.", form, instructions, most)
