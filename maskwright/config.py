"""Entity types and settings."""

from __future__ import annotations

from dataclasses import dataclass, field

# The entity types, their names in reports, and the stand-ins of the fake-data mode.
LABELS = {
    "PERSON": "Names",
    "ORG": "Organizations",
    "LOCATION": "Locations",
    "ADDRESS": "Street addresses",
    "EMAIL": "Emails",
    "PHONE": "Phone numbers",
    "SSN": "SSNs",
    "CREDIT_CARD": "Credit cards",
    "IBAN": "IBANs",
    "IP_ADDRESS": "IP addresses",
    "URL": "URLs",
    "DATE": "Dates",
    "ZIP": "ZIP codes",
    "ID_NUMBER": "ID / account / MRN numbers",
    "SENSITIVE": "Sensitive attributes",
    "CUSTOM": "Custom terms",
}
POOLS = {
    "PERSON": ["Alex Morgan", "Jordan Lee", "Taylor Reed", "Casey Brooks", "Riley Hayes", "Morgan Diaz", "Jamie Patel", "Avery Chen", "Quinn Foster", "Drew Kim"],
    "ORG": ["Acme Corp", "Globex Inc", "Initech", "Umbrella LLC", "Stark Industries", "Wayne Enterprises"],
    "LOCATION": ["Springfield", "Riverton", "Lakeside", "Fairview", "Greenville", "Madison"],
    "ADDRESS": ["123 Main Street", "456 Oak Avenue", "789 Pine Road", "22 Elm Lane", "9 Cedar Court"],
    "EMAIL": ["user1@example.com", "user2@example.com", "user3@example.com", "user4@example.com"],
    "PHONE": ["(555) 010-0001", "(555) 010-0002", "(555) 010-0003", "(555) 010-0004"],
    "SSN": ["000-00-0001", "000-00-0002", "000-00-0003"],
    "CREDIT_CARD": ["0000 0000 0000 0001", "0000 0000 0000 0002"],
    "URL": ["https://example.com/1", "https://example.com/2"],
    "DATE": ["01/01/2000", "02/02/2000", "03/03/2000", "04/04/2000"],
    "ZIP": ["00001", "00002", "00003"],
    "IP_ADDRESS": ["192.0.2.1", "192.0.2.2", "192.0.2.3"],
}
# End of fixed values.

TYPES = tuple(LABELS)
MODES = ("label", "redact", "pseudonymize")
#: Stage of a candidate, the high part of `ord`.
RULE, DENY, HEADER, MODEL = range(4)
SPAN = "start int, end int, type string, text string, source string, score double, ord bigint"


@dataclass(frozen=True)
class RedactionConfig:
    """What to look for and what to put in its place."""

    enabled: frozenset[str] = field(default_factory=lambda: frozenset(TYPES) - {"ORG"})
    mode: str = "label"
    min_score: float = 0.5
    deny: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}, not {self.mode!r}")
        if unknown := self.enabled - set(TYPES):
            raise ValueError(f"unknown types: {sorted(unknown)}")
