"""The keyword dimension: five lists with a severity each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwatch.operators.skew import lookup_join

# The five keyword lists, in their order.
CRITICAL = [
    "ransomware", "wiper", "data destruction", "disk encryption",
    "supply chain attack", "supply chain compromise", "software supply chain", "trusted relationship",
    "zero-day", "zero day", "n-day exploit", "remote code execution", "rce", "code injection", "command injection",
    "privilege escalation", "token manipulation", "access token manipulation", "sudo abuse", "setuid",
    "dll hijacking",
    "lateral movement", "pass the hash", "pass the ticket", "remote service", "psexec", "wmi execution",
    "credential dumping", "credentials from password stores", "lsass", "mimikatz", "brute force",
    "password spraying",
    "backdoor", "implant", "bootkit", "rootkit", "scheduled task", "registry run key",
    "phishing", "spearphishing", "watering hole", "drive-by compromise", "exploit public-facing application",
    "command and control", "c2", "c&c", "beaconing", "dns tunneling",
    "data exfiltration", "exfiltration over c2", "automated exfiltration", "transfer data to cloud",
    "obfuscation", "process injection", "reflective dll injection", "process hollowing", "defense evasion",
    "disable security tools", "indicator removal",
]
HIGH = [
    "execution", "persistence", "defense evasion", "powershell", "cmd", "macro", "scripting",
    "windows management instrumentation",
]
MEDIUM = [
    "discovery", "collection", "reconnaissance", "network scanning", "port scanning", "credential scanning",
]
GROUPS = [
    "apt1", "apt28", "apt29", "apt32", "apt33", "apt34", "apt37", "apt38", "apt39", "apt41",
    "lazarus", "fancy bear", "cozy bear", "carbanak", "fin7", "fin8",
    "sandworm", "turla", "equation group", "winnti", "dragonfly",
]
FAMILIES = [
    "emotet", "trickbot", "ryuk", "maze", "revil", "sodinokibi",
    "cobalt strike", "metasploit", "conti", "lockbit", "blackcat",
    "wannacry", "notpetya", "petya", "bad rabbit",
]

LISTS: dict[str, list[str]] = {
    "critical": CRITICAL,
    "high": HIGH,
    "medium": MEDIUM,
    "group": GROUPS,
    "family": FAMILIES,
}
# The severity of each list; a keyword in several lists takes the first one's.
SEVERITY = {"critical": "critical", "high": "high", "medium": "medium", "group": "high", "family": "high"}


def keyword_dim(spark: SparkSession, lists: Mapping[str, Sequence[str]] = LISTS) -> DataFrame:
    """All lists end to end, duplicates kept: ``(pos, category, keyword, severity)``."""
    flat = [(c, w) for c, words in lists.items() for w in words]
    rows = [(i, c, w, SEVERITY.get(c, "low")) for i, (c, w) in enumerate(flat)]
    return spark.createDataFrame(rows, "pos int, category string, keyword string, severity string")


def keyword_severity(df: DataFrame, column: str, dim: DataFrame, name: str = "severity") -> DataFrame:
    """Adds the severity of the keyword in ``column``, ``low`` when it is in no list; upper and lower case are equal.

    ``dim`` is reduced to one row per keyword first, so the join keeps the row count.
    """
    best = dim.groupBy(F.lower("keyword").alias("_k")).agg(F.min_by("severity", "pos").alias("_s"))
    return (
        lookup_join(df.withColumn("_k", F.lower(F.col(column))), best, "_k", "left")
        .withColumn(name, F.coalesce("_s", F.lit("low")))
        .drop("_k", "_s")
    )


def keyword_list_counts(dim: DataFrame) -> DataFrame:
    return dim.groupBy("category").agg(F.count(F.lit(1)).alias("n_keywords"))
