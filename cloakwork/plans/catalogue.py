"""Patterns, labels, presets, templates and term lists.

Values that results depend on stand here as they must be; how they are applied is in functions and operators. A detector
table is a tuple of Detector, whose order matters: it settles ties. Case-insensitive matching follows Unicode, words may
hold accented letters, and unbounded repetitions are possessive, so long texts can't overflow the regex engine's stack.
"""

from __future__ import annotations

from dataclasses import dataclass

# Building blocks of the patterns.
TITLES = r"(?:M\.?|Mme\.?|Mlle\.?|Dr\.?|Prof\.?|Me\.?|Maître)"

# What each kind of personal data looks like.
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"\b(?:\+33|0)(?:[1-5]|[67])(?:[ .-]?\d{2}){4}\b"
IBAN = r"\bFR\d{2}\s?\d{5}\s?\d{5}\s?[A-Z0-9]{11}\s?\d{2}\b"
DATE = r"\b(?:0?[1-9]|[12][0-9]|3[01])[-/](?:0?[1-9]|1[0-2])[-/](?:19|20)\d{2}\b"
PERSON = rf"\b{TITLES}\s+(?!(?:[Ll]e|[Ll]a|[Ll]es|[Pp]résident(?:e)?s?)\b)[A-ZÀ-Ÿ][a-zà-ÿ]+(?:\s+[A-ZÀ-Ÿ][a-zà-ÿ]+)*+"
ORG = r"\b(?:SARL|SAS|SA|SNC|EURL|SASU|SCI|SELARL|SELCA|SELAS|Association|Société|Entreprise|Cabinet|Étude|Bureau|Groupe|Fondation|Institut|Centre|Établissement)\s+[A-ZÀ-Ÿ][A-Za-zÀ-ÿ\s\-'&]++"
SSN = r"\b[12]\d{2}(?:0[1-9]|1[0-2])(?:[0-9]{2}|2A|2B)\d{3}\d{3}\d{2}\b"
SIRET = r"\b\d{3}\s?\d{3}\s?\d{3}\s?\d{5}\b"
SIREN = r"\b\d{3}\s?\d{3}\s?\d{3}\b"
TVA = r"\bFR\d{2}\d{9}\b"
ADDRESS = r"\b\d{1,4}\s?(?:bis|ter|quater)?\s+(?:rue|avenue|boulevard|place|square|impasse|allée|chemin|route|passage|villa|cité|quai|esplanade|parvis|cours|mail|faubourg)\s+[A-Za-zÀ-ÿ'\-\s]+,?\s\d{5}\s[A-Za-zÀ-ÿ'\-\s]+\b"
MOBILE = r"\b(?:\+33|0)[67](?:[ .-]?\d{2}){4}\b"
LANDLINE = r"\b(?:\+33|0)[1-5](?:[ .-]?\d{2}){4}\b"
ARTICLE = r"\b[Aa]rt(?:icle)?\.?\s+[LDR]\d+(?:-\d+)*\s+du\s+Code\s+[A-Za-zÀ-ÿ\s]+\b"
CASE = r"\b(?:n°|N°|numéro|Numéro)\s*:?\s*\d{2,}/\d{2,}(?:/\d{2,})?\b"
COURT = r"\bRG\s*:?\s*\d{2}/\d{5}\b"


@dataclass(frozen=True)
class Detector:
    """name: the pattern's own; type: the entities'; guard: a regex that every match's text must meet, which is cheaper to look for."""

    name: str
    type: str
    pattern: str
    guard: str | None = None
    ignore_case: bool = True

    @property
    def java(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern


#: What documents are searched for by default, in order.
RUNTIME = (
    Detector("EMAIL", "EMAIL", EMAIL, "@"),
    Detector("PHONE", "PHONE", PHONE, r"\d{2}"),
    Detector("IBAN", "IBAN", IBAN, r"(?i)FR\d{2}"),
    Detector("DATE", "DATE", DATE, r"\d[-/](?:19|20)\d{2}"),
    Detector("PERSON_FR", "PERSON", PERSON),
    Detector("ORG_FR", "ORG", ORG),
    Detector("SSN_FR", "SSN", SSN, r"[12]\d{4}"),
    Detector("SIRET_FR", "SIRET", SIRET, r"\d{3}"),
    Detector("SIREN_FR", "SIREN", SIREN, r"\d{3}"),
    Detector("TVA_FR", "TVA", TVA, r"(?i)FR\d{11}"),
    Detector("FRENCH_ADDRESS", "FRENCH_ADDRESS", ADDRESS, r"\s\d{5}\s"),
    Detector("FRENCH_MOBILE", "FRENCH_MOBILE", MOBILE, r"\d{2}"),
    Detector("FRENCH_LANDLINE", "FRENCH_LANDLINE", LANDLINE, r"\d{2}"),
    Detector("ARTICLE_LOI", "LEGAL_REF", ARTICLE, r"(?i)code"),
    Detector("NUMERO_DOSSIER", "CASE_NUMBER", CASE, r"\d{2}/\d{2}"),
    Detector("RG_NUMBER", "COURT_REF", COURT, r"\d{2}/\d{5}"),
)

# Further patterns, by type, for detector tables of one's own.
EXTENDED_PATTERNS = {
    "EMAIL": EMAIL,
    "PHONE": PHONE,
    "DATE": DATE,
    "TIME": r"\b(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?\b",
    "ADDRESS": ADDRESS,
    "IBAN": IBAN,
    "CREDIT_CARD": r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    "BIC": r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
    "SIREN": SIREN,
    "SIRET": SIRET,
    "SSN": SSN,
    "TVA_NUMBER": TVA,
    "POSTAL_CODE": r"\b(?:0[1-9]|[1-8]\d|9[0-5])\d{3}\b",
    "LICENSE_PLATE": r"\b[A-Z]{2}-\d{3}-[A-Z]{2}\b",
    "LEGAL_REFERENCE": ARTICLE,
    "CASE_NUMBER": CASE,
    "COURT_REFERENCE": COURT,
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "URL": r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:\w*)?)?)?",
    "MAC_ADDRESS": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "MONEY": r"\b\d+(?:\s?\d{3})*(?:[,.]\d{2})?\s?(?:€|EUR|euros?|francs?)\b",
    "PERCENTAGE": r"\b\d+(?:[,.]\d+)?\s?%\b",
    "PERSON_WITH_TITLE": PERSON,
    "FRENCH_COMPANY": ORG,
    "FRENCH_SSN": SSN,
    "INSEE_NUMBER": r"\b[12]\d{14}\b",
    "FRENCH_ADDRESS": ADDRESS,
    "PREFECTURE_REF": r"\b\d{3}-\d{4}-\d{5}\b",
    "CADASTRE_REF": r"\b\d{3}[A-Z]{2}\d{4}\b",
    "FRENCH_MOBILE": MOBILE,
    "FRENCH_LANDLINE": LANDLINE,
}
#: The form that legal references have in the table without French extensions.
PLAIN_LEGAL_REFERENCE = r"\b[Aa]rticle\s+\d+(?:-\d+)?\s+(?:du\s+)?(?:Code\s+)?[A-Za-zÀ-ÿ\s]+\b"
EXTENDED = tuple(Detector(k, k, p) for k, p in EXTENDED_PATTERNS.items())


def detectors(*types: str, ignore_case: bool = True) -> tuple[Detector, ...]:
    """A table of the extended patterns of these types."""
    return tuple(Detector(k, k, EXTENDED_PATTERNS[k], ignore_case=ignore_case) for k in types)


# Types with a checksum or strict format, which also win conflicts; what stands for a type; how sure a model's label is.
VALIDATED = ("EMAIL", "PHONE", "IBAN", "SIRET", "SIREN", "SSN", "TVA")
LABELS = {"PERSON": "[PERSONNE]", "ORG": "[ORGANISATION]", "EMAIL": "[EMAIL]", "PHONE": "[PHONE]", "IBAN": "[IBAN]", "DATE": "[DATE]"}
EXTENDED_LABELS = {
    "EMAIL": "[EMAIL]",
    "PHONE": "[TÉLÉPHONE]",
    "DATE": "[DATE]",
    "ADDRESS": "[ADRESSE]",
    "IBAN": "[IBAN]",
    "CREDIT_CARD": "[CARTE_BANCAIRE]",
    "PERSON": "[PERSONNE]",
    "ORG": "[ORGANISATION]",
    "SSN": "[NUMÉRO_SS]",
    "SIRET": "[SIRET]",
    "SIREN": "[SIREN]",
    "TVA_NUMBER": "[TVA]",
    "LEGAL_REFERENCE": "[RÉFÉRENCE_LÉGALE]",
    "CASE_NUMBER": "[NUMÉRO_DOSSIER]",
    "COURT_REFERENCE": "[RÉFÉRENCE_TRIBUNAL]",
    "MISC": "[DIVERS]",
}
METHOD_RANK = {"regex": 3, "spacy": 2, "transformers": 1}
RENAMED = {"PERSON_FR": "PERSON", "ORG_FR": "ORG", "SSN_FR": "SSN", "SIRET_FR": "SIRET", "SIREN_FR": "SIREN", "TVA_FR": "TVA", "ARTICLE_LOI": "LEGAL_REF", "NUMERO_DOSSIER": "CASE_NUMBER", "RG_NUMBER": "COURT_REF"}
HARMONISED = {"PERSON_WITH_TITLE": "PERSON", "PERSON_FR": "PERSON", "FRENCH_COMPANY": "ORG", "ORG_FR": "ORG"}
MODEL_LABELS = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORG", "LOC": "LOCATION", "GPE": "LOCATION", "MISC": "MISC", "DATE": "DATE", "TIME": "DATE", "MONEY": "MONEY", "PERCENT": "PERCENT", "CARDINAL": "NUMBER", "ORDINAL": "NUMBER"}
TRANSFORMER_LABELS = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORG", "ORGANIZATION": "ORG", "LOC": "LOCATION", "LOCATION": "LOCATION", "MISC": "MISC", "DATE": "DATE", "TIME": "DATE"}
MODEL_TRUST = {"PER": 0.92, "PERSON": 0.92, "ORG": 0.88, "LOC": 0.85, "GPE": 0.85, "MISC": 0.75, "DATE": 0.90, "MONEY": 0.88, "PERCENT": 0.85}

# Presets, from the smallest to the largest.
PRESETS = {
    "light": (("EMAIL", "PHONE", "ADDRESS"), 0.8),
    "standard": (("EMAIL", "PHONE", "ADDRESS", "PERSON", "ORG", "DATE", "IBAN", "SSN"), 0.7),
    "complete": (("EMAIL", "PHONE", "ADDRESS", "PERSON", "ORG", "DATE", "IBAN", "SSN", "SIRET", "SIREN", "TVA_NUMBER", "CREDIT_CARD", "LEGAL_REFERENCE", "CASE_NUMBER", "COURT_REFERENCE"), 0.6),
    "gdpr_compliant": (("EMAIL", "PHONE", "ADDRESS", "PERSON", "ORG", "DATE", "IBAN", "SSN", "SIRET", "SIREN", "TVA_NUMBER", "CREDIT_CARD", "LEGAL_REFERENCE", "CASE_NUMBER", "COURT_REFERENCE", "MISC"), 0.5),
}
#: Names that presets use for types that detectors name otherwise.
PRESET_ALIASES = {"ADDRESS": "FRENCH_ADDRESS", "LEGAL_REFERENCE": "LEGAL_REF", "COURT_REFERENCE": "COURT_REF", "TVA_NUMBER": "TVA"}


@dataclass(frozen=True)
class Template:
    name: str
    keywords: tuple[str, ...]
    entities: tuple[str, ...]
    preserve: tuple[str, ...]
    distinguish_parties: bool
    geo_anonymization: bool


# Kinds of legal document; the first whose keyword a text holds is taken.
TEMPLATES = (
    Template("contrat_bail", ("contrat de bail", "bailleur", "locataire"), ("PERSON", "ORG", "DATE", "ADDRESS", "MONEY"), ("LEGAL_REFERENCE",), True, True),
    Template("procedure_civile", ("procédure civile", "tribunal", "audience"), ("PERSON", "ORG", "DATE", "CASE_NUMBER", "COURT_REFERENCE", "LEGAL_REFERENCE"), ("LEGAL_REFERENCE",), True, False),
    Template("acte_notarie", ("notarié", "notaire", "acte authentique"), ("PERSON", "ORG", "DATE", "ADDRESS", "MONEY", "LEGAL_REFERENCE"), ("LEGAL_REFERENCE", "MONEY"), False, True),
)

# What anonymised texts are searched for, in the case as written.
LEAKS = {
    "email_like": EMAIL,
    "phone_like": r"\b(?:\+33|0)[1-9](?:[0-9\s.-]{8,})\b",
    "iban_like": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]*\b",
    "potential_name": r"\b[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}\b",
    "date_like": r"\b\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}\b",
}

# Terms that look like names but are none.
CITIES = ("Paris", "Lyon", "Marseille", "Le Havre", "La Rochelle", "Saint Pierre", "Notre Dame", "Compiègne", "THOUROTTE", "COMPIÈGNE")
LEGAL_TERMS = ("Code Civil", "Code Penal", "Cour Supreme", "Tribunal Administratif")
PROFESSIONS = ("Docteur", "Avocat", "Professeur", "Ingenieur", "Notaire", "Maitre", "Maître")

# Words around names.
PARTICLES = ("de", "du", "des", "d", "van", "von", "la", "le", "del", "di", "da", "dos", "das", "do", "ten", "ter")
STOP_WORDS = ("le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "dans", "que", "qui", "pour", "par")
CIVIL_TITLES = ("maître", "maitre", "m.", "mr", "mme", "mlle", "dr", "me", "docteur", "professeur")
NAME_TITLES = ("mr", "mme", "dr", "me", "maître")
PERSON_TITLES = ("m", "mr", "mme", "mlle", "dr", "me", "maitre", "maître")
LONG_TITLES = ("monsieur", "madame", "mademoiselle", "docteur", "professeur", "maître")
SHORT_TITLES = ("monsieur", "madame", "docteur")
LEADING_VERBS = ("débouter", "contacter", "rencontrer")
ORG_WORDS = ("société", "entreprise", "sarl", "sas", "cabinet", "étude", "bureau")
