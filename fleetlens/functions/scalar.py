"""Scalar layer: column functions over names, endpoints, options, images, versions, durations and quantities.

All are Catalyst expressions. A text that doesn't parse gives null (or a column that says so), never an exception.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports.
PEER_PORT, CLIENT_PORT = 2380, 2379
# Option defaults, in order.
DEFAULT_ARGS = (
    "--name=$(POD_NAME)", "--listen-peer-urls=http://0.0.0.0:2380", "--listen-client-urls=http://0.0.0.0:2379",
    "--initial-advertise-peer-urls=http://$(POD_NAME).{name}.$(POD_NAMESPACE).svc.cluster.local:2380",
    "--advertise-client-urls=http://$(POD_NAME).{name}.$(POD_NAMESPACE).svc.cluster.local:2379",
)
# Nanoseconds of each duration unit; factors and divisors of the quantity suffixes.
DURATION_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
QUANTITY_FACTORS = {"": 1, "k": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "P": 10**15, "E": 10**18, "Ki": 2**10, "Mi": 2**20, "Gi": 2**30, "Ti": 2**40, "Pi": 2**50, "Ei": 2**60}
QUANTITY_DIVISORS = {"n": 10**9, "u": 10**6, "m": 10**3}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def member_name(name, ordinal) -> Column:
    return F.concat(col(name), F.lit("-"), col(ordinal).cast("string"))


def endpoint(name, namespace, ordinal, port: int) -> Column:
    return F.concat(F.lit("http://"), member_name(name, ordinal), F.lit("."), col(name), F.lit("."), col(namespace), F.lit(f".svc.cluster.local:{port}"))


def peer_endpoint(name, namespace, ordinal) -> Column:
    return endpoint(name, namespace, ordinal, PEER_PORT)


def client_endpoint(name, namespace, ordinal) -> Column:
    return endpoint(name, namespace, ordinal, CLIENT_PORT)


def _ordinals(n) -> Column:
    """0 to n - 1; empty for 0 or null (a bare sequence would count down)."""
    return F.when(col(n) > 0, F.sequence(F.lit(0), col(n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def client_endpoints(name, namespace, replicas) -> Column:
    return F.when(col(replicas) > 0, F.transform(_ordinals(replicas), lambda i: client_endpoint(name, namespace, i)))


def bootstrap_state(replicas) -> Column:
    return F.when(col(replicas) <= 1, "new").otherwise("existing")


def bootstrap_list(name, namespace, replicas) -> Column:
    return F.array_join(F.transform(_ordinals(replicas), lambda i: F.concat(member_name(name, i), F.lit("="), peer_endpoint(name, namespace, i))), ",")


def bootstrap_config(name, namespace, replicas, data_dir: str = "/var/lib/kv") -> Column:
    """The map of settings that a workload of that many replicas should have."""
    pairs = (("state", bootstrap_state(replicas)), ("members", bootstrap_list(name, namespace, replicas)), ("data_dir", F.lit(data_dir)))
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])


def arg_name(option) -> Column:
    s = col(option)
    return F.when(F.instr(s, "=") > 0, F.substring_index(s, "=", 1)).when(F.instr(s, " ") > 0, F.substring_index(s, " ", 1)).otherwise(F.trim(s))


def effective_args(name, options) -> Column:
    """The defaults that no option overrides, then all options, each in its order."""
    given = F.coalesce(col(options), F.array().cast("array<string>"))
    names = F.transform(given, arg_name)
    defaults = F.array(*[F.replace(F.lit(d), F.lit("{name}"), col(name)) for d in DEFAULT_ARGS])
    return F.concat(F.filter(defaults, lambda d: ~F.array_contains(names, arg_name(d))), given)


def merge_labels(custom, defaults) -> Column:
    """A default wins over a custom label of the same key; null custom labels are none."""
    none = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    return F.map_zip_with(F.coalesce(col(custom), none), col(defaults), lambda _, c, d: F.coalesce(d, c))


def default_registry(registry, default: str) -> Column:
    return F.coalesce(F.nullif(col(registry), F.lit("")), F.lit(default))


def image_ref(registry, version) -> Column:
    return F.concat(col(registry), F.lit(":"), col(version))


def image_tag(image, mode: str = "first") -> Column:
    """What follows the first colon ('last': the last one); null without a colon."""
    i = col(image)
    tag = F.substring_index(i, ":", -1) if mode == "last" else F.substr(i, F.instr(i, ":") + F.lit(1))
    return F.when(F.instr(i, ":") > 0, tag)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hex_id(id) -> Column:
    """Lower hexadecimal of an unsigned 64-bit id."""
    return F.lower(F.conv(col(id).cast("decimal(20,0)").cast("string"), 10, 16))


def duration_ns(text, default_ns: int) -> Column:
    """Nanoseconds; the default for empty text; null where the text is no duration. Days are no unit. Whole numbers and
    fractions (of up to 18 digits) are multiplied by the unit one by one, and what is less than a nanosecond is cut off."""
    t = col(text)
    whole = F.regexp_extract(t, "^[0-9]+", 0).try_cast("bigint") * F.when(F.endswith(t, F.lit("h")), DURATION_UNITS["h"]).when(F.endswith(t, F.lit("m")), DURATION_UNITS["m"]).otherwise(DURATION_UNITS["s"])
    # most texts are one small whole number of a unit
    return F.when(t == "", F.lit(default_ns).cast("bigint")).when(t.rlike("^[0-9]{1,6}[hms]$"), whole).otherwise(once(t, lambda t: _duration(t, default_ns)))


def _duration(t: Column, default_ns: int) -> Column:
    unit = "(?:ns|us|µs|μs|ms|s|m|h)"
    parts = F.regexp_extract_all(t, F.lit(rf"([0-9]+\.?[0-9]*|\.[0-9]+){unit}"), F.lit(0))
    factor = F.create_map(*[x for u, n in DURATION_UNITS.items() for x in (F.lit(u), F.lit(n).cast("decimal(14,0)"))])

    def value(part: Column) -> Column:
        unit_ns = F.try_element_at(factor, F.regexp_extract(part, r"[^0-9.]+$", 0))
        whole = F.concat(F.lit("0"), F.regexp_extract(part, r"^[0-9]*", 0)).try_cast("decimal(20,0)") * unit_ns
        below = F.concat(F.lit("0."), F.substring(F.regexp_extract(part, r"\.([0-9]*)", 1), 1, 18), F.lit("0")).try_cast("decimal(18,18)")
        return (whole + F.floor(below * unit_ns)).cast("decimal(38,0)")

    total = F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda a, p: (a + value(p)).cast("decimal(38,0)"))
    signed = once(total, lambda n: F.when(F.startswith(t, F.lit("-")), -n).otherwise(n).try_cast("bigint"))
    return F.when(t == "", F.lit(default_ns).cast("bigint")).when(t.isin("0", "+0", "-0"), F.lit(0).cast("bigint")).when(t.rlike(rf"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+){unit})+$"), signed)


def quantity(text) -> Column:
    """decimal(38,9) units; null where the text is no quantity. What is less than the ninth decimal is rounded away from zero, of a
    fraction's digits after the 16th as well; numbers that are too large give the largest. Exponents may have a fraction."""
    t = col(text)
    plain = {k: v for k, v in QUANTITY_FACTORS.items() if v < 10**13}
    factor = F.try_element_at(F.create_map(*[x for k, v in plain.items() for x in (F.lit(k), F.lit(str(v)).cast("decimal(13,0)"))]), F.regexp_extract(t, "[A-Za-z]*$", 0))
    whole = F.regexp_extract(t, "^[0-9]+", 0).try_cast("decimal(15,0)") * factor
    # most texts are a whole number
    return F.when(t.rlike("^[0-9]{1,15}([KMGT]i|[kMGT])?$"), whole.cast("decimal(38,9)")).otherwise(once(t, _quantity))


def _quantity(t: Column) -> Column:
    suffix = F.regexp_extract(t, r"^[+-]?[0-9.]+(.*)$", 1)
    pick = lambda table, kind: F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(str(v)).cast(kind))]), suffix)
    digits = F.regexp_extract(t, r"^[+-]?[0-9]*\.([0-9]*)", 1)
    whole = F.concat(F.lit("0"), F.regexp_extract(t, r"^[+-]?([0-9]*)", 1)).try_cast("decimal(38,0)")
    least = F.when(digits.rlike("^.{16}.*[1-9]"), F.lit("0.0000000000000001")).otherwise("0").cast("decimal(16,16)")
    below = F.concat(F.lit("0."), F.substring(digits, 1, 16), F.lit("0")).cast("decimal(16,16)") + least
    factor = pick(QUANTITY_FACTORS, "decimal(19,0)")
    large = F.try_add(F.try_multiply(whole, factor).try_cast("decimal(37,9)"), F.ceil(below * factor, F.lit(9)).try_cast("decimal(37,9)"))
    nano = pick({k: 10**9 // v for k, v in QUANTITY_DIVISORS.items()}, "decimal(7,0)")
    small = (F.try_add(F.try_multiply(whole, nano), F.ceil(below * nano).cast("decimal(38,0)")).try_cast("decimal(27,0)") / F.lit(10**9).cast("decimal(10,0)")).try_cast("decimal(38,9)")
    exponent = F.regexp_extract(suffix, r"^[eE]([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))$", 1).try_cast("double")
    power = (F.regexp_extract(t, r"^[+-]?([0-9.]+)", 1).try_cast("double") * F.pow(F.lit(10.0), exponent)).try_cast("decimal(38,9)")
    size = F.coalesce(large, small, power, F.lit("9" * 29 + "." + "9" * 9).cast("decimal(38,9)"))
    units = once(size, lambda n: F.when(F.startswith(t, F.lit("-")), -n).otherwise(n))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([KMGTPE]i|[numkMGTPE]|[eE][+-]?([0-9]+\.?[0-9]*|\.[0-9]+))?$"), units)


_SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"


def semver(text, strip_v: bool = False) -> Column:
    """struct(major, minor, patch), or null where the text is no version."""
    t = F.regexp_replace(col(text), "^v", "") if strip_v else col(text)
    part = [F.regexp_extract(t, _SEMVER, i).try_cast("bigint").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]
    return F.when(t.rlike(_SEMVER), F.struct(*part))


def probe_text(endpoint, health, took, has_status, is_learner, error) -> Column:
    said = lambda b: F.when(col(b), "true").otherwise("false")
    learner = F.when(col(has_status), F.concat(F.lit(", isLearner: "), said(is_learner))).otherwise("")
    failed = F.when(F.coalesce(col(error), F.lit("")) != "", F.concat(F.lit("error: "), col(error))).otherwise("")
    return F.concat(F.lit("endpoint: "), col(endpoint), F.lit(", health: "), said(health), F.lit(", took: "), col(took), learner, failed)


def quorum(n) -> Column:
    return F.floor(col(n) / 2).cast("bigint") + 1
