"""The two rubrics as dimension tables: sections, their elements in order, and each element's maximum score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal

# Section, maximum score of each of its elements, elements.
CANCER = [
    ("Outcomes", 5, ["Health", "Financial Risk Protection", "User Satisfaction", "Psychosocial Support Services"]),
    ("Objectives", 5, ["Effectiveness", "Efficiency", "Equity", "Responsiveness"]),
    ("Outputs", 5, ["Individual Health Services", "Population Health Services", "Community-Based Palliative Care", "Cancer Surveillance Systems"]),
    ("Functions", 3, ["Governance and Organisation", "Financing", "Resource Management"]),
    ("Threats", 2, ["Demographic Threats", "Epidemiologic Threats", "Political Threats", "Legal Threats", "Sociocultural Threats", "Economic Threats", "Ecological Threats", "Technological Threats"]),
    ("Opportunities", 2, ["Demographic Opportunities", "Epidemiologic Opportunities", "Political Opportunities", "Legal Opportunities", "Sociocultural Opportunities", "Economic Opportunities", "Ecological Opportunities", "Technological Opportunities"]),
    ("Strategy", 3, ["Vision", "Mission", "Goals", "Objectives", "Values", "Integration with Noncommunicable Disease Programs"]),
    ("Governance and Organisation", 3, ["Macro-organization", "Governance", "Policy", "Regulation", "Decentralization", "Strategic public private partnerships"]),
    ("Financing", 3, ["Cost measurement systems", "Current financing and fiscal space", "Proposed funding to implement plan", "Sources of funds", "Pooling of funds", "Channeling of funds", "Allocation of funds", "Payment mechanisms for providers", "Payment mechanisms for capital investments", "Resource Mobilization Strategies", "Financing for Governance and Oversight"]),
    ("Resource Management", 3, ["Human resources", "Capacity Building for Health Professionals", "Infrastructure", "Pharmaceuticals and medical supplies", "Patient Navigation", "Information technology and data systems", "Supply chain management", "Knowledge Generation", "Innovation ecosystem", "Education Initiatives", "Innovation Initiatives"]),
    ("Health Services", 5, ["Public Health Services (Health promotion)", "Public Health Services (Health protection)", "Public Health Services (Disease Prevention)", "Personal Healthcare Services (Diagnosis)", "Personal Healthcare Services (Treatment)", "Personal Healthcare Services (Palliation and rehabilitative care)", "Provider Value Enhancement"]),
    ("Implementation", 5, ["Monitoring and Evaluation framework", "Change management", "Risk and Mitigation Strategies", "Stakeholder engagement"]),
]
CARDIOVASCULAR = [
    ("Outcomes", 5, ["Health", "Financial Risk Protection", "User Satisfaction"]),
    ("Objectives", 5, ["Effectiveness", "Efficiency", "Equity", "Responsiveness"]),
    ("Outputs", 5, ["Individual Health Services", "Population Health Services", "CVD Surveillance Systems"]),
    ("Threats", 2, ["Demographic Threats", "Epidemiologic Threats", "Political Threats", "Legal Threats", "Sociocultural Threats", "Economic Threats", "Ecological Threats", "Technological Threats"]),
    ("Opportunities", 2, ["Demographic Opportunities", "Epidemiologic Opportunities", "Political Opportunities", "Legal Opportunities", "Sociocultural Opportunities", "Economic Opportunities", "Ecological Opportunities", "Technological Opportunities"]),
    ("Strategic Direction", 3, ["Vision", "Mission", "Goals", "Objectives", "Values", "Integration with Noncommunicable Disease Programs"]),
    ("Governance Arrangements", 3, ["Macro-organization", "Governance", "Policy", "Regulation", "Decentralization", "Strategic public private partnerships"]),
    ("Financing", 3, ["Cost measurement systems", "Current financing and fiscal space", "Proposed funding to implement plan", "Sources of funds", "Pooling of funds", "Channeling of funds", "Allocation of funds", "Payment mechanisms for providers", "Payment mechanisms for capital investments", "Resource Mobilization Strategies", "Financing for Governance and Oversight"]),
    ("Resource Management", 3, ["Human resources", "Capacity Building for Health Professionals", "Infrastructure", "Pharmaceuticals and medical supplies", "Patient Navigation", "Information technology and data systems", "Supply chain management", "Knowledge Generation", "Innovation ecosystem"]),
    ("Health Services", 5, ["Public Health Services (Health promotion)", "Public Health Services (Health protection)", "Public Health Services (Disease Prevention)", "Personal Healthcare Services (Diagnosis)", "Personal Healthcare Services (Treatment)", "Personal Healthcare Services (Rehabilitation)", "Provider Value Enhancement"]),
    ("Implementation", 5, ["Monitoring and Evaluation framework", "Change management", "Risk and Mitigation Strategies", "Stakeholder engagement"]),
]
# The countries of the filtered export.
COMMONWEALTH = [
    "Australia", "Bangladesh", "Barbados", "Bermuda", "Cameroon", "Canada", "Cook Islands", "Cyprus", "Ghana", "India", "Isle of Man", "Jamaica", "Kenya", "Malawi", "Malaysia", "Maldives", "Malta", "Mauritius", "Mozambique", "New Zealand", "Nigeria", "Rwanda", "South Africa", "Sri Lanka", "Togo", "United Kingdom", "Zambia", "Zimbabwe",
]
TARGET_MAX, UNKNOWN_MAX = 5.0, 5


def sections(domain: str = "cancer") -> list[tuple[str, int, list[str]]]:
    """Any domain other than cancer is the cardiovascular one."""
    return CANCER if domain == "cancer" else CARDIOVASCULAR


def elements(domain: str = "cancer") -> list[tuple[int, str, int, str, int]]:
    """section_ord, section, element_ord, category, max_score."""
    out = []
    for k, (section, most, names) in enumerate(sections(domain)):
        out += [(k, section, len(out) + i, name, most) for i, name in enumerate(names)]
    return out


def names(domain: str = "cancer") -> list[str]:
    return [e[3] for e in elements(domain)]


def max_scores(domain: str = "cancer") -> dict[str, int]:
    return {e[3]: e[4] for e in elements(domain)}


def dimension(spark: SparkSession, domain: str = "cancer") -> DataFrame:
    """At most 76 rows, fixed: always worth a broadcast."""
    return F.broadcast(literal(spark, elements(domain), ["section_ord", "section", "element_ord", "category", "max_score"]))


def normalised(score: Column, max_score: Column, target_max: float = TARGET_MAX) -> Column:
    """Score on a scale to target_max; an unknown element counts up to 5; not clamped."""
    most = F.coalesce(max_score, F.lit(UNKNOWN_MAX))
    return F.when(most == 0, 0.0).otherwise(score.cast("double") / most * F.lit(float(target_max)))
