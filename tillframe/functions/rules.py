"""Ordered keyword rules as CASE expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Sequence[str]]]

# Category names and their keywords, first matching rule wins.
ERP_CATEGORIES: Rules = (
    ("Luminaires", ("CANDLE", "LIGHT", "LAMP", "LANTERN", "LED")),
    ("Sacs & Accessoires", ("BAG", "TOTE", "PURSE", "SATCHEL")),
    ("Art de la Table", ("MUG", "CUP", "TEA", "COFFEE", "PLATE", "BOWL")),
    ("Décoration Murale", ("FRAME", "SIGN", "CLOCK", "MIRROR")),
    ("Emballages & Cadeaux", ("CARD", "WRAP", "RIBBON", "GIFT", "BOX")),
    ("Nature & Romantique", ("HEART", "ROSE", "FLOWER", "BIRD", "BUTTERFLY")),
)
MDM_CATEGORIES: Rules = (
    ("Sacs & Accessoires", ("bag", "tote", "purse", "handbag")),
    ("Luminaires", ("lamp", "light", "lantern", "candle", "holder")),
    ("Art de la Table", ("mug", "cup", "plate", "bowl", "glass", "jar")),
    ("Decoration Murale", ("frame", "sign", "plaque", "poster", "wall")),
    ("Emballages & Cadeaux", ("box", "wrap", "ribbon", "gift", "tag", "basket")),
    ("Nature & Romantique", ("flower", "heart", "rose", "romantic", "love")),
)
OTHER_CATEGORY = "Divers"

# Question keywords and the query each rule selects.
QUESTION_RULES: Rules = (
    ("worst_rated_products", ("critique", "alerte", "mauvais", "négatif")),
    ("best_sellers", ("produit", "vente", "best", "top", "meilleur")),
    ("customer_satisfaction", ("segment", "rentable", "satisfait", "quadrant", "cluster")),
    ("top_customers", ("client", "acheteur", "fidèle")),
    ("best_rated_products", ("avis", "note", "sentiment", "satisfaction")),
    ("data_quality_summary", ("qualité", "mdm", "couverture", "mapping")),
    ("revenue_by_category", ("ca", "chiffre", "revenu", "revenue")),
)
DEFAULT_QUESTION = "best_sellers"
# Question keywords that force the rule-based query over a written one.
FORCED_QUESTION_WORDS = (
    "segment", "rentable", "satisfait", "quadrant", "cluster",
    "rfm", "récence", "fréquence", "monétaire", "profil client",
)
# Question keywords and the follow-up analysis each rule selects.
ANALYSIS_RULES: Rules = (
    ("segmentation", ("segment", "rentable", "satisfait", "quadrant")),
    ("clustering", ("cluster", "groupe", "automatique", "k-means", "natural")),
    ("correlation", ("corrélation", "corrélé", "lien entre", "impact de")),
    ("trend", ("tendance", "evolution", "évolution", "mois par mois", "mensuel")),
    ("rfm", ("rfm", "récence", "fréquence", "monétaire", "profil client")),
)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when one of ``words`` occurs in ``text`` as a substring."""
    return text.rlike("|".join(re.escape(w) for w in words))


def first_rule(text: Column, rules: Rules, default: str | None) -> Column:
    """The label of the first rule with a keyword inside ``text``."""
    case = None
    for label, words in rules:
        hit = contains_any(text, words)
        case = F.when(hit, label) if case is None else case.when(hit, label)
    return case.otherwise(F.lit(default))


def erp_category(name: Column) -> Column:
    return first_rule(F.upper(F.coalesce(name, F.lit(""))), ERP_CATEGORIES, OTHER_CATEGORY)


def mdm_category(name: Column) -> Column:
    return first_rule(F.lower(F.coalesce(name, F.lit(""))), MDM_CATEGORIES, OTHER_CATEGORY)


def route_question(question: Column) -> Column:
    return first_rule(F.lower(question), QUESTION_RULES, DEFAULT_QUESTION)


def route_analysis(question: Column) -> Column:
    return first_rule(F.lower(question), ANALYSIS_RULES, None)
