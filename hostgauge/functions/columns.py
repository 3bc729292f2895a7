"""Column helpers: JSON text to variants, and columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F


def whole_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else, else null.

    ``try_parse_json`` stops after the first value and ignores what follows. So the
    text is parsed as the first element of an array whose second is a hash of the
    text: an array that ends early, or holds more, lacks it in its place. Of a key
    given twice the last value counts (a setting of the session).
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def marked(t: Column) -> Column:
        return F.struct(t.alias("text"), F.hex(F.xxhash64(t)).alias("mark"))

    def parsed(t: Column) -> Column:
        text = F.concat(F.lit("["), t["text"], F.lit(',"'), t["mark"], F.lit('"]'))
        return F.struct(F.try_parse_json(text).alias("v"), t["mark"].alias("mark"))

    def first_element(w: Column) -> Column:
        whole = F.try_variant_get(w["v"], "$[1]", "string") == w["mark"]
        return F.when(whole & F.try_variant_get(w["v"], "$[2]", "variant").isNull(), F.try_variant_get(w["v"], "$[0]", "variant"))

    # lambda variables, so that the text is worked out, hashed and parsed once for all look-ups
    steps = F.transform(F.transform(F.transform(F.array(text), marked), parsed), first_element)
    return F.element_at(steps, 1)


def once(c: Column) -> Column:
    """``c`` as a generated column. Spark moves a filter below plain columns by
    repeating their expression in it, but not below generated ones."""
    return F.explode(F.array(c))
