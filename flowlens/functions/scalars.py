"""Column expressions: services, protocols, flags, bins, outcomes, seeded keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit of each TCP flag.
FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}
#: Ports of each service; any other port is OTHER_SERVICE.
SERVICE_PORTS = {0: (53,), 1: (80, 443), 2: (22,), 3: (20, 21), 4: (25, 110, 143, 465, 587, 993, 995), 5: (3389,), 6: (139, 445)}
OTHER_SERVICE = 7
TCP, UDP, ICMP = 6, 17, 1


def service_id(port: Column) -> Column:
    """W4."""
    out = F.lit(OTHER_SERVICE)
    for service, ports in reversed(SERVICE_PORTS.items()):
        out = F.when(port.isin(*ports), service).otherwise(out)
    return out


def is_tcp() -> Column:
    """W5."""
    return F.col("protocol") == TCP


def is_udp() -> Column:
    return F.col("protocol") == UDP


def is_icmp() -> Column:
    return F.col("protocol") == ICMP


def is_dns(with_port: bool = False) -> Column:
    """W6; the audit form also takes flows to port 53."""
    found = (F.col("dns_query_id") != 0) | (F.col("dns_query_type") != 0) | (F.col("dns_ttl_answer") != 0)
    return found | (F.col("l4_dst_port") == 53) if with_port else found


def has_flag(flags: str, name: str) -> Column:
    """W7."""
    return F.col(flags).bitwiseAND(F.lit(FLAG_BITS[name])) != 0


def byte_share() -> Column:
    """In / max(in + out, 1)."""
    return F.col("in_bytes") / F.greatest(F.col("in_bytes") + F.col("out_bytes"), F.lit(1))


def bytes_per_packet() -> Column:
    """Bytes / max(packets, 1)."""
    return (F.col("in_bytes") + F.col("out_bytes")) / F.greatest(F.col("in_pkts") + F.col("out_pkts"), F.lit(1))


def is_logged(name: str) -> bool:
    """Whether a feature is taken as log1p before scaling."""
    return not name.endswith(("_ratio", "_entropy", "_fraction"))


def logged(name: str) -> Column:
    """log1p of a feature that is no share; a negative value is an error."""
    if not is_logged(name):
        return F.col(name)
    return F.when(F.col(name) < 0, F.raise_error(F.lit(f"{name} is negative")).cast("double")).otherwise(F.log1p(name))


def occupancy_band(active: Column) -> Column:
    """1 -> 0, 2-4 -> 1, 5 and more -> 2."""
    return F.when(active <= 1, 0).when(active <= 4, 1).otherwise(2)


def bin_right(value: Column, edges: list[float], names: list[str]) -> Column:
    """Right-closed bins; ``names`` has one more entry than ``edges``."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        out = F.when(value <= edge, name).otherwise(out)
    return F.when(value.isNull(), None).otherwise(out)


def fraction_bin(value: Column) -> Column:
    """Attack-flow fraction: at most 1, 10, 50 %, below 100 %, all."""
    return F.when(value == 1, "all").otherwise(bin_right(value, [0.01, 0.1, 0.5], ["<=1%", "1-10%", "10-50%", "50-100%"]))


def active_bin(value: Column) -> Column:
    return bin_right(value, [1, 5], ["1", "2-5", "6-10"])


def flow_bin(value: Column) -> Column:
    return bin_right(value, [2, 10, 100], ["1-2", "3-10", "11-100", "101+"])


def outcome(label: Column, predicted: Column) -> Column:
    """W13."""
    return F.when(label == 1, F.when(predicted, "TP").otherwise("FN")).otherwise(F.when(predicted, "FP").otherwise("TN"))


def paired_outcome(before: Column, after: Column) -> Column:
    """Of one positive under two models."""
    return F.when(before & after, "retained_tp").when(before, "lost").when(after, "recovered").otherwise("persistent_fn")


def pseudonym(c: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def canonical_zero(c: Column) -> Column:
    """-0.0 becomes 0.0."""
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def seeded_key(seed: int | str, *key: Column) -> Column:
    """An order or draw that depends on seed and key only: 48 bits of MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
