"""Membership of addresses in networks, v4 and v6, as an equi-join on prefix bits.

An address becomes its bit string behind a family digit. For each prefix length that occurs among the
networks (at most 162) its prefix is a join key, so no range join is needed and the network list may
have any size. Only the lengths of each family are broadcast, two rows of at most 129 numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Published edge networks of a large CDN, the default list.
CDN_NETWORKS = [
    "173.245.48.0/20", "103.21.244.0/22", "103.22.200.0/22", "103.31.4.0/22", "141.101.64.0/18", "108.162.192.0/18", "190.93.240.0/20", "188.114.96.0/20",
    "197.234.240.0/22", "198.41.128.0/17", "162.158.0.0/15", "104.16.0.0/13", "104.24.0.0/14", "172.64.0.0/13", "131.0.72.0/22",
    "2400:cb00::/32", "2606:4700::/32", "2803:f800::/32", "2405:b500::/32", "2405:8100::/32", "2a06:98c0::/29", "2c0f:f248::/32",
]
_V4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(?!$)|$)){4}$"
_V6 = r"(?i)^(?=.*:)(?!.*:::)(?!.*::.*::)(:|[0-9a-f]{1,4})(:[0-9a-f]{0,4}){1,8}$"


def _bits(groups: Column, width: int, base: int) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, base, 2), width, "0")), "")


def address_bits(ip: Column) -> Column:
    """"4" and 32 bits, or "6" and 128 bits; null for anything that is not an address."""
    v4 = F.concat(F.lit("4"), _bits(F.split(ip, r"\."), 8, 10))
    left = F.filter(F.split(F.substring_index(ip, "::", 1), ":"), lambda g: g != "")
    right = F.filter(F.split(F.when(F.contains(ip, F.lit("::")), F.substring_index(ip, "::", -1)).otherwise(""), ":"), lambda g: g != "")
    gap = 8 - F.size(left) - F.size(right)
    groups = F.concat(left, F.array_repeat(F.lit("0"), gap), right)
    whole = F.when(F.contains(ip, F.lit("::")), gap >= 1).otherwise(gap == 0)
    return F.when(ip.rlike(_V4), v4).when(ip.rlike(_V6) & whole, F.concat(F.lit("6"), _bits(groups, 16, 16)))


def load_cidrs(lines: DataFrame, builtin: list[str] | None = None, column: str = "value") -> DataFrame:
    """Networks (cidr, length, prefix) of a text with one network a line; blank lines, # comments and
    bad lines are ignored, a bare address is a network of its own; the built-in list is added."""
    spark = lines.sparkSession
    text = F.trim(F.col(column))
    own = lines.where((text != "") & ~text.startswith("#")).select(text.alias("cidr"))
    known = spark.createDataFrame([(c,) for c in (CDN_NETWORKS if builtin is None else builtin)], "cidr string")
    parts = F.split("cidr", "/")
    bits = address_bits(parts[0])
    full = F.when(F.substring(bits, 1, 1) == "4", 32).otherwise(128)
    length = F.when(F.size(parts) == 1, full).otherwise(F.get(parts, F.lit(1)).try_cast("int"))
    out = own.unionByName(known).select("cidr", length.alias("length"), bits.alias("bits"), full.alias("full"))
    out = out.where(F.col("bits").isNotNull() & F.col("length").between(0, F.col("full")))
    return out.select("cidr", "length", F.col("bits").substr(F.lit(1), F.col("length") + 1).alias("prefix")).distinct()


def builtin_cidrs(spark: SparkSession) -> DataFrame:
    return load_cidrs(spark.createDataFrame([], "value string"))


def ip_in_cidrs(df: DataFrame, cidrs: DataFrame, ip: str = "client", label: str = "in_cdn") -> DataFrame:
    """``df`` with a boolean: the address lies in some network. Invalid addresses are in none.

    Distinct addresses are tested, then joined back."""
    each = df.select(ip).where(F.col(ip).isNotNull()).distinct().withColumn("_bits", address_bits(F.col(ip))).where("_bits IS NOT NULL")
    lengths = cidrs.groupBy(F.substring("prefix", 1, 1).alias("_family")).agg(F.collect_set("length").alias("_lengths"))
    keyed = each.withColumn("_family", F.substring("_bits", 1, 1)).join(F.broadcast(lengths), "_family")
    keys = F.transform("_lengths", lambda n: F.col("_bits").substr(F.lit(1), n + 1))
    hit = keyed.select(ip, F.explode(keys).alias("prefix")).join(cidrs.select("prefix").distinct(), "prefix", "left_semi")
    inside = hit.select(ip).distinct().withColumn(label, F.lit(True))
    return df.join(inside, ip, "left").withColumn(label, F.coalesce(label, F.lit(False)))
