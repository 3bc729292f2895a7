"""Raw log lines to the event layout: probe JSON and two audit dialects.

Every reader takes a table with ``value`` (the line) and ``ingest_ts``; where a
line carries no usable time the latter is taken and ``time_from_ingest`` is true.
No line ends a job: a number that its column cannot hold counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostgauge.fixed_values import (
    AUDIT_KV_NAMES, AUDIT_KV_PATTERN, AUDIT_KV_TIME_PATTERN, AUDIT_SYSCALL_PATTERN, AUDIT_TIME_PATTERN,
)
from hostgauge.functions.columns import once, whole_json
from hostgauge.functions.text import iso_to_micros
from hostgauge.schemas import EVENT_SCHEMA
from hostgauge.sources.dictionary import unnamed, with_event_id, with_event_name

_TYPES = {f.name: f.dataType.simpleString() for f in EVENT_SCHEMA}


def _stripped(text: str) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r"))


def _digits(text: Column, kind: str = "bigint") -> Column:
    """The number a text spells; 0 where it spells none or one that ``kind`` cannot hold."""
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def _ingest_seconds() -> Column:
    return F.unix_micros("ingest_ts") / 1_000_000


def _layout(df: DataFrame, columns: dict[str, Column], *keep: str) -> DataFrame:
    defaults = {"stackAddresses": F.lit("[]"), "args": F.lit("[]"), "sus": F.lit(0), "evil": F.lit(0)}
    columns = defaults | columns
    return df.select(*[columns[c].try_cast(t).alias(c) for c, t in _TYPES.items()], *keep)


# -- probe JSON -----------------------------------------------------------------------

_EVENT_KEYS = [
    "eventName", "event_name", "eventId", "event_id", "args", "arguments", "returnValue", "return_value", "retval",
    "timestamp", "ts", "context", "processContext", "processId", "pid", "threadId", "tid", "parentProcessId", "ppid",
    "userId", "uid", "mountNamespace", "mntNS", "processName", "comm", "hostName", "stackAddresses", "stack",
    "syscall", "mnt_ns", "ret",
]
_CONTEXT_KEYS = [
    "pid", "processId", "tid", "threadId", "ppid", "parentProcessId", "uid", "userId", "mntNS", "mountNamespace",
    "processName", "comm",
]


def _has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def _members(v: Column, keys: list[str]) -> Column:
    """The named members of a JSON object as a struct, taken apart once."""
    return F.try_variant_get(v, "$", "struct<" + ", ".join(f"{k}: variant" for k in keys) + ">")


def _first_of(members: Column, *keys: str) -> Column:
    """The value under the first key that exists, even if that value is null."""
    return F.coalesce(*[members[k] for k in keys])


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _whole(v: Column) -> Column:
    """Number (or digits) to a whole number, anything else and numbers beyond 64 bits to 0."""
    number = F.coalesce(F.try_variant_get(v, "$", "bigint"), F.try_variant_get(v, "$", "double").try_cast("bigint"))
    return F.coalesce(number, F.lit(0).cast("bigint"))


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def _shown(v: Column) -> Column:
    """Text of an argument value the way the collector prints it."""
    return (
        F.when(v.isNull(), "")
        .when(F.is_variant_null(v), "None")
        .when(_text(v).isin("true", "false") & (F.schema_of_variant(v) == "BOOLEAN"), F.initcap(_text(v)))
        .otherwise(F.coalesce(_text(v), F.lit("")))
    )


def ingest_probe_json(
    lines: DataFrame, dictionary: DataFrame, default_host: str = "", time_unit: float = 1.0, *, keep: tuple = ()
) -> DataFrame:
    """Probe JSON lines in three shapes: plain event, event under ``event``, and
    the older one keyed by ``syscall``. Other lines are dropped.

    ``time_unit`` is the length of a numeric timestamp's unit in seconds.
    """
    parsed = lines.withColumn("_line", once(whole_json(_stripped("value"))))
    line = F.col("_line")
    plain = _has(line, "eventName") | _has(line, "eventId")
    wrapped = F.try_variant_get(line, "$.event", "variant")
    shape = (
        F.when(plain, "event").when(wrapped.isNotNull(), "event").when(_has(line, "syscall"), "legacy")
    )
    rows = (
        parsed.withColumn("_shape", shape)
        .where(F.col("_shape").isNotNull())
        .withColumn("_e", once(_members(F.when(plain | (F.col("_shape") == "legacy"), line).otherwise(wrapped), _EVENT_KEYS)))
    )
    e = F.col("_e")
    legacy = F.col("_shape") == "legacy"
    rows = rows.withColumns({
        "_ctx": _first_of(e, "context", "processContext"),
        "_args": F.when(legacy, _first_of(e, "args")).otherwise(_first_of(e, "args", "arguments")),
        "_time": F.when(legacy, _first_of(e, "timestamp")).otherwise(_first_of(e, "timestamp", "ts")),
    })
    raw_ctx, ctx = F.col("_ctx"), F.col("_c")
    # The process context is used when it is an object or absent; a context of
    # another kind is ignored in favour of the event's own short names.
    rows = rows.withColumn("_c", once(_members(raw_ctx, _CONTEXT_KEYS)))
    rows = rows.withColumn("_with_ctx", raw_ctx.isNull() | ctx.isNotNull())
    with_ctx = F.col("_with_ctx")

    def who(ctx_keys: tuple, top_key: str, bare_keys: tuple, legacy_key: str) -> Column:
        modern = F.when(
            with_ctx, F.coalesce(_first_of(ctx, *ctx_keys), _first_of(e, top_key))
        ).otherwise(_first_of(e, *bare_keys))
        return F.when(legacy, _first_of(e, legacy_key)).otherwise(modern)

    elements = F.try_variant_get(F.col("_args"), "$", "array<variant>")
    objects = F.filter(elements, _is_object)
    kept = F.transform(
        objects,
        lambda a: F.struct(
            F.coalesce(F.try_variant_get(a, "$.name", "string"), F.lit("")).alias("name"),
            F.coalesce(F.try_variant_get(a, "$.type", "string"), F.lit("")).alias("type"),
            _shown(F.try_variant_get(a, "$.value", "variant")).alias("value"),
        ),
    )
    modern_args = F.coalesce(F.to_json(kept), F.lit("[]"))
    legacy_args = F.coalesce(F.to_json("_args"), F.lit("[]"))
    returned = _first_of(e, "returnValue", "return_value", "retval")
    returned = F.when(F.try_variant_get(returned, "$", "double").isNotNull() & (F.schema_of_variant(returned) != "STRING"), _whole(returned)).otherwise(0)
    # two names that differ in case only, so they cannot be members of one struct
    ctx_host = F.coalesce(*[F.try_variant_get(raw_ctx, f"$.{k}", "variant") for k in ("hostName", "hostname")])
    host = F.coalesce(_text(F.when(with_ctx, ctx_host).otherwise(_first_of(e, "hostName"))), F.lit(default_host))
    time_text = _text(F.col("_time"))
    seconds = F.coalesce(time_text.try_cast("double") * time_unit, iso_to_micros(time_text) / 1_000_000)
    stack = _first_of(e, "stackAddresses", "stack")
    name = F.when(legacy, _text(_first_of(e, "syscall"))).otherwise(
        F.coalesce(_text(_first_of(e, "eventName", "event_name")), F.lit("unknown"))
    )
    rows = rows.withColumns({
        "eventName": name,
        "_id": F.when(legacy, F.lit(0).cast("bigint")).otherwise(_digits(_whole(_first_of(e, "eventId", "event_id")), "int").cast("bigint")),
        "_seconds": seconds,
    })
    rows = with_event_id(rows, dictionary, "eventName", "_by_name")
    out = _layout(
        rows,
        {
            "timestamp": F.coalesce("_seconds", _ingest_seconds()),
            "processId": _whole(who(("pid", "processId"), "processId", ("processId", "pid"), "pid")),
            "threadId": F.when(legacy, 0).otherwise(_whole(who(("tid", "threadId"), "threadId", ("threadId", "tid"), "tid"))),
            "parentProcessId": _whole(who(("ppid", "parentProcessId"), "parentProcessId", ("parentProcessId", "ppid"), "ppid")),
            "userId": _whole(who(("uid", "userId"), "userId", ("userId", "uid"), "uid")),
            "mountNamespace": _whole(who(("mntNS", "mountNamespace"), "mountNamespace", ("mountNamespace", "mntNS"), "mnt_ns")),
            "processName": F.coalesce(_text(who(("processName", "comm"), "processName", ("processName", "comm"), "comm")), F.lit("")),
            "hostName": F.when(legacy, F.lit(default_host)).otherwise(host),
            "eventId": F.when(F.col("_id") != 0, F.col("_id")).otherwise(F.col("_by_name")),
            "eventName": F.col("eventName"),
            "stackAddresses": F.when(~legacy & _is_array(stack), F.to_json(stack)).otherwise(F.lit("[]")),
            "argsNum": F.coalesce(F.size(elements), F.lit(0)),
            "returnValue": F.when(legacy, _whole(_first_of(e, "ret"))).otherwise(returned),
            "args": F.when(legacy, legacy_args).otherwise(modern_args),
        },
        F.col("_seconds").isNull().alias("time_from_ingest"),
        *keep,
    )
    return out


# -- audit lines -------------------------------------------------------------------------


def ingest_auditd(
    lines: DataFrame, dictionary: DataFrame, default_host: str = "", uid_source: str = "uid", *, keep: tuple = ()
) -> DataFrame:
    """auditd SYSCALL records. Columns ``auid`` and ``uid`` hold both users.

    The record pattern's user group finds the first ``uid=`` after the pid, also
    inside ``auid=``; ``uid_source="auid"`` takes that one, the default the
    record's own uid.
    """
    line = F.col("value")
    rows = lines.where(line.contains("type=SYSCALL")).withColumn("_lower", once(F.lower(line)))
    # Plain tests first: a line that lacks one of these would keep the pattern
    # trying every way to match.
    for word in ("syscall=", "success=", "exit=", "a0=", "ppid=", "uid=", 'comm="'):
        rows = rows.where(F.col("_lower").contains(word))
    rows = rows.drop("_lower")
    # One search yields all groups; a line without a match stays whole.
    groups = F.regexp_replace(line, f"(?s)^.*?{AUDIT_SYSCALL_PATTERN}.*$", "\u001f".join(f"${i}" for i in range(1, 9)))
    rows = rows.withColumn("_part", once(F.split(groups, "\u001f"))).where(F.size("_part") == 8)

    def part(i: int) -> Column:
        return F.col("_part")[i - 1]

    exit_code = _digits(part(3))
    first_uid = _digits(part(7))
    own_uid = F.regexp_extract(line, r"\buid=(\d+)", 1).try_cast("bigint")
    when = F.nullif(F.regexp_extract(line, AUDIT_TIME_PATTERN, 1), F.lit("")).try_cast("double")
    rows = rows.withColumns({
        "eventId": _digits(part(1), "int"),
        "auid": first_uid,
        "uid": F.coalesce(own_uid, first_uid),
        "_seconds": when,
    })
    rows = with_event_name(rows, dictionary)
    given = sum((line.contains(f"a{i}=").cast("int") for i in range(4)), F.lit(0))
    return _layout(
        rows,
        {
            "timestamp": F.coalesce("_seconds", _ingest_seconds()),
            "processId": _digits(part(6)),
            "threadId": F.lit(0),
            "parentProcessId": _digits(part(5)),
            "userId": F.col("auid" if uid_source == "auid" else "uid"),
            "mountNamespace": F.lit(0),
            "processName": part(8),
            "hostName": F.lit(default_host),
            "eventId": F.col("eventId"),
            "eventName": F.col("eventName"),
            "argsNum": given,
            "returnValue": F.when(F.lower(part(2)) == "yes", exit_code).otherwise(-F.abs(exit_code)),
        },
        "auid",
        "uid",
        F.col("_seconds").isNull().alias("time_from_ingest"),
        *keep,
    )


def ingest_audit_kv(lines: DataFrame, default_host: str = "", *, keep: tuple = ()) -> DataFrame:
    """Audit records read as key=value pairs, of which the last one of a key counts."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("value", F.lit(AUDIT_KV_PATTERN), F.lit(1)).alias("k"),
        F.regexp_extract_all("value", F.lit(AUDIT_KV_PATTERN), F.lit(2)).alias("v"),
    )
    rows = lines.where(F.col("value").contains("type=SYSCALL")).withColumn("_kv", pairs)

    def last(key: str) -> Column:
        return F.try_element_at(F.filter("_kv", lambda p: p["k"] == key), F.lit(-1))["v"]

    def number(key: str, default: int) -> Column:
        return F.coalesce(last(key).try_cast("bigint"), F.lit(default))

    call = F.coalesce(last("syscall"), F.lit(""))
    event_id = F.when(call.rlike(r"^\d+$"), _digits(call, "int")).otherwise(0)
    name = F.when(F.lit(False), "")
    for k, v in AUDIT_KV_NAMES.items():
        name = name.when(call == str(k), v)
    when = F.nullif(F.regexp_extract(F.coalesce(last("msg"), F.lit("")), AUDIT_KV_TIME_PATTERN, 1), F.lit(""))
    return _layout(
        rows,
        {
            "timestamp": F.coalesce(when.try_cast("double"), F.lit(0.0)),
            "processId": number("pid", 0),
            "threadId": F.lit(None),
            "parentProcessId": number("ppid", 0),
            "userId": number("uid", -1),
            "mountNamespace": F.lit(0),
            "processName": F.lit(None),
            "hostName": F.lit(default_host),
            "eventId": event_id,
            "eventName": F.coalesce(name, unnamed(call)),
            "argsNum": F.lit(0),
            "returnValue": number("exit", 0),
        },
        *keep,
    )
