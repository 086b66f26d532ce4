"""The reference incidents that rows are compared with, and lookups on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwatch.sources.schemas import INCIDENT

# Fixed values: (id, name, date, description, severity, tactics), in list order; the position is the index.
INCIDENTS = [
    (
        "CISA-2020-SOLARWINDS", "SolarWinds Supply Chain Attack", "2020-12-13",
        "Advanced persistent threat actors compromised SolarWinds Orion software updates, inserting a backdoor "
        "trojan (SUNBURST) that affected thousands of organizations globally. The supply chain compromise enabled "
        "persistent access to victim networks through legitimate software update mechanisms, demonstrating "
        "sophisticated tactics for initial access and persistence in enterprise environments.",
        "critical", ["initial-access", "persistence", "command-and-control"],
    ),
    (
        "CISA-2021-COLONIAL", "Colonial Pipeline Ransomware Attack", "2021-05-07",
        "DarkSide ransomware gang targeted Colonial Pipeline, the largest fuel pipeline in the US, forcing a "
        "complete shutdown of operations. The attack used stolen credentials for initial access and deployed "
        "ransomware that encrypted critical operational systems. The incident highlighted vulnerabilities in "
        "critical infrastructure and the impact of ransomware on physical operations.",
        "critical", ["initial-access", "lateral-movement", "impact"],
    ),
    (
        "CISA-2021-LOG4J", "Log4j Remote Code Execution Vulnerability", "2021-12-10",
        "Critical zero-day vulnerability (CVE-2021-44228) in Apache Log4j logging library allowed unauthenticated "
        "remote code execution via specially crafted JNDI lookup strings. The widespread use of Log4j in Java "
        "applications created massive attack surface affecting millions of systems globally. Threat actors actively "
        "exploited this for initial access, deploying cryptocurrency miners, ransomware, and remote access trojans.",
        "critical", ["initial-access", "execution"],
    ),
    (
        "CISA-2021-EXCHANGE", "Microsoft Exchange ProxyLogon Vulnerabilities", "2021-03-02",
        "Multiple zero-day vulnerabilities in Microsoft Exchange Server allowed attackers to bypass authentication "
        "and execute arbitrary code on vulnerable servers. Chinese APT group HAFNIUM exploited these vulnerabilities "
        "for initial access, deploying web shells for persistence and exfiltrating sensitive data from email "
        "systems. Over 30,000 US organizations were compromised.",
        "critical", ["initial-access", "persistence", "credential-access"],
    ),
    (
        "CISA-2021-KASEYA", "Kaseya VSA Ransomware Supply Chain Attack", "2021-07-02",
        "REvil ransomware gang exploited zero-day vulnerability in Kaseya VSA remote management software, "
        "compromising managed service providers (MSPs) to deploy ransomware to downstream customers. The supply "
        "chain attack affected approximately 1,500 organizations through trusted MSP relationships, demonstrating "
        "the multiplier effect of targeting software supply chains.",
        "critical", ["initial-access", "execution", "impact"],
    ),
    (
        "CISA-2022-LAPSUS", "LAPSUS$ Extortion Campaign", "2022-03-22",
        "LAPSUS$ threat group conducted social engineering and SIM swapping attacks to compromise employee "
        "credentials at major technology companies including Microsoft, Okta, and NVIDIA. The group focused on "
        "stealing source code and proprietary data for extortion, using purchased credentials from underground "
        "markets and exploiting weak multi-factor authentication implementations.",
        "high", ["initial-access", "credential-access", "exfiltration"],
    ),
    (
        "CISA-2023-MOVEit", "MOVEit Transfer SQL Injection Zero-Day", "2023-05-31",
        "Critical SQL injection vulnerability (CVE-2023-34362) in Progress MOVEit Transfer file transfer software "
        "exploited by Cl0p ransomware gang. Attackers used the zero-day to steal data from organizations before "
        "deploying ransomware, affecting hundreds of organizations including government agencies, universities, and "
        "healthcare providers through managed file transfer compromise.",
        "critical", ["initial-access", "exfiltration"],
    ),
    (
        "CISA-2023-3CX", "3CX Supply Chain Compromise", "2023-03-29",
        "North Korean threat actors compromised 3CX desktop application through supply chain attack, distributing "
        "trojanized installers to 600,000+ users globally. The malicious update included backdoor functionality for "
        "command-and-control communications, enabling persistent access for espionage and credential theft across "
        "thousands of organizations.",
        "critical", ["initial-access", "persistence", "command-and-control"],
    ),
    (
        "CISA-2022-CONFLUENCE", "Atlassian Confluence Remote Code Execution", "2022-06-02",
        "Critical unauthenticated remote code execution vulnerability (CVE-2022-26134) in Atlassian Confluence "
        "Server and Data Center allowed attackers to execute arbitrary code through OGNL injection. Widely exploited "
        "for deploying web shells, cryptocurrency miners, and establishing persistent access to corporate knowledge "
        "bases containing sensitive intellectual property.",
        "critical", ["initial-access", "execution", "persistence"],
    ),
    (
        "CISA-2023-BARRACUDA", "Barracuda Email Security Gateway Zero-Day", "2023-05-23",
        "Chinese espionage group UNC4841 exploited zero-day vulnerability in Barracuda Email Security Gateway "
        "appliances for remote command injection. Attackers deployed sophisticated malware for persistent access, "
        "targeting government, military, and defense organizations for long-term espionage operations through "
        "compromised email security infrastructure.",
        "critical", ["initial-access", "persistence", "collection"],
    ),
    (
        "CISA-2024-IVANTI", "Ivanti Connect Secure VPN Zero-Days", "2024-01-10",
        "Multiple zero-day vulnerabilities in Ivanti Connect Secure VPN appliances allowed authentication bypass and "
        "remote code execution. Chinese state-sponsored groups exploited these vulnerabilities to compromise VPN "
        "gateways, deploying custom malware for credential harvesting and lateral movement into corporate networks "
        "through trusted remote access infrastructure.",
        "critical", ["initial-access", "credential-access", "lateral-movement"],
    ),
    (
        "CISA-2022-FORTINET", "FortiOS SSL-VPN Authentication Bypass", "2022-10-10",
        "Authentication bypass vulnerability (CVE-2022-40684) in FortiOS and FortiProxy SSL-VPN allowed "
        "unauthenticated attackers to perform administrative operations via crafted HTTP requests. Widely exploited "
        "for initial access to corporate networks, allowing attackers to modify firewall configurations, create "
        "rogue admin accounts, and establish persistent backdoors.",
        "critical", ["initial-access", "persistence", "defense-evasion"],
    ),
]


def incidents(spark: SparkSession) -> DataFrame:
    """The built-in incidents with ``idx``, their 0-based list position."""
    rows = [
        (i, key, name, dt.date.fromisoformat(date), text, severity, tactics)
        for i, (key, name, date, text, severity, tactics) in enumerate(INCIDENTS)
    ]
    return spark.createDataFrame(rows, INCIDENT)


def incident_lookup(table: DataFrame, incident_id: str) -> DataFrame:
    """The incident with this id: one row, or none."""
    return table.where(F.col("id") == incident_id).orderBy("idx").limit(1)


def incident_texts(table: DataFrame) -> DataFrame:
    return table.select("idx", "description")


def incident_text_length(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("n_incidents"), F.avg(F.length("description")).alias("mean_description_length")
    )
