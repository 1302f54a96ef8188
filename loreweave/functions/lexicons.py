"""Rule tables. The word lists, patterns, confidences and description heads are fixed values of the rule set."""

from __future__ import annotations

from dataclasses import dataclass

# Names of things, words that start no name, places, words that mark a vehicle.
ARTIFACTS = ("Ice", "Longclaw", "Needle", "Oathkeeper", "Widow's Wail", "Dawn", "Heartsbane", "Blackfyre", "Dark Sister", "Lightbringer", "Catspaw", "Iron Throne")
COMMON_WORDS = ("The", "A", "An", "He", "She", "It", "They", "We", "You", "I", "His", "Her", "Their", "My", "Your", "This", "That", "These", "Those", "And", "But", "Or", "If", "Then", "When", "Where", "What", "Who", "How", "Why", "All", "Some", "Any", "No", "Not", "Yes")
PLACES = ("Winterfell", "Braavos", "Pentos", "Meereen", "Astapor", "Yunkai", "Volantis", "Dorne", "Highgarden", "Casterly Rock", "Storm's End", "Dragonstone", "Harrenhal", "The Eyrie", "Riverrun", "Pyke", "Oldtown", "Sunspear", "The Twins")
VEHICLE_WORDS = ("sail", "sailed", "sailing", "ship", "aboard", "board", "boarded", "captain", "deck", "port", "harbor", "harbour", "voyage", "seas", "storm", "fleet", "vessel", "anchor")

@dataclass(frozen=True)
class MentionRule:
    """seq orders rules; kind is the type of what the pattern finds."""

    seq: int
    kind: str
    pattern: str


def _whole(word: str) -> str:
    return rf"\b{word}\b"


#: Patterns of titles, houses, artifacts, places, then names of two words or more and epithets; vehicles (5) need their context too.
MENTION_RULES = (
    MentionRule(1, "title", r"\bLord of (?:the )?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"),
    MentionRule(1, "title", r"\bKing of (?:the )?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"),
    MentionRule(1, "title", r"\bQueen of (?:the )?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"),
    MentionRule(1, "title", r"\bHand of the King\b"),
    MentionRule(2, "group", r"\bHouse [A-Z][a-z]+\b"),
    *(MentionRule(3, "artifact", _whole(a)) for a in ARTIFACTS),
    MentionRule(4, "place", r"\bThe Wall\b"),
    MentionRule(4, "place", r"\bKing's Landing\b"),
    *(MentionRule(4, "place", _whole(p)) for p in PLACES if " " not in p and "'" not in p),
    MentionRule(5, "vehicle", r"\b[Tt]he [A-Z][a-z]+(?: [A-Z][a-z]+)*\b"),
    MentionRule(6, "person", r"\b[A-Z][a-z]+(?:\s+(?:the\s+)?[A-Z][a-z]+)+\b"),
    MentionRule(7, "person", r"\b[A-Z][a-z]+ the [A-Z][a-z]+\b"),
)


@dataclass(frozen=True)
class ObligationRule:
    """family orders rules in a category; link names the entity type to relate; a fragment counts only outside questions."""

    category: str
    family: int
    head: str
    confidence: float
    patterns: tuple[str, ...]
    link: str | None = None
    fragment: bool = False


#: Patterns, all without regard to case.
OBLIGATION_RULES = (
    ObligationRule("prophecy_vision", 1, "Prophecy/vision reference", 0.7, (r"\bprophec\w*\b", r"\bvision\b", r"\bdreams?\b", r"\bforetold\b", r"\bforeseen\b")),
    ObligationRule("prophecy_vision", 2, "Known prophecy phrase", 0.9, ("three heads", "prince that was promised", "azor ahai")),
    ObligationRule("chekhov_gun", 1, "Narrative setup", 0.8, (r"\bwould need it later\b", r"\bkept it hidden\b", r"\bshe kept it hidden\b", r"\bhe kept it hidden\b", r"\bkeep it hidden\b"), "artifact"),
    ObligationRule("chekhov_gun", 2, "Significant item", 0.75, (r"\b(sword|blade|dagger|weapon)\b.*\b(valyrian|steel|forged)\b", r"\b(valyrian|steel|forged)\b.*\b(sword|blade|dagger|weapon)\b", r"\bvial\b.*\b(poison|potion)\b", r"\b(poison|potion)\b.*\bvial\b", r"\bpoison\b", r"\bsword\s+\w+\s+hung\b"), "artifact"),
    ObligationRule("mystery", 1, "Unresolved question", 0.75, (r"\bwho had\b[^?]*\?", r"\bwhy would\b[^?]*\?", r"\bwhat was\b[^?]*\?")),
    ObligationRule("mystery", 2, "Unresolved question", 0.75, (r"\bwho had\b", r"\bwhy would\b", r"\bwhat was\b"), fragment=True),
    ObligationRule("mystery", 3, "Mystery keyword", 0.7, (r"\bsecret\b", r"\bhidden truth\b", r"\bno one knew\b", r"\btrue parentage\b", r"\breal name\b")),
    ObligationRule("plot_thread", 1, "Oath/promise", 0.75, (r"\bswear\b", r"\boath\b", r"\bpromise\b", r"\bvow\b"), "person"),
    ObligationRule("plot_thread", 2, "Journey thread", 0.7, (r"\bset off toward\b", r"\bjourney\b.*\b(ahead|long)\b", r"\b(ahead|long)\b.*\bjourney\b"), "place"),
    ObligationRule("plot_thread", 3, "Unresolved conflict", 0.7, (r"\bwar\b.*\b(inevitable|brewing|coming)\b", r"\bconflict\b.*\b(would not|wouldn't|not end)\b")),
)
CATEGORIES = ("prophecy_vision", "chekhov_gun", "mystery", "plot_thread")
#: Sections of the dossier, in its order.
DOSSIER_ORDER = ("prophecy_vision", "mystery", "chekhov_gun", "plot_thread")

#: Classes in order of precedence.
EVENT_RULES = (
    ("battle", r"\bbattle\b|\bwar\b|\bsiege\b"),
    ("death", r"\bdied\b|\bkilled\b|\bslain\b"),
    ("treaty", r"\btreaty\b|\btruce\b"),
    ("betrayal", r"\bbetray\w*\b|\btreachery\b"),
    ("marriage", r"\bmarriage\b|\bmarried\b|\bwedding\b"),
    ("coronation", r"\bcoronation\b|\bcrowned\b"),
    ("travel", r"\bjourney\b|\btraveled\b|\bset out\b|\bdeparted\b"),
    ("discovery", r"\bdiscovered\b|\bfound\b|\buncovered\b"),
)
#: Relations in order of precedence.
RELATION_RULES = (
    ("alliance", r"\ballied with\b"),
    ("enmity", r"\benemy\b|\benmity\b"),
    ("kinship", r"\bson of\b|\bdaughter of\b|\bbrother\b|\bsister\b"),
    ("oath", r"\bswore\b|\boath\b"),
    ("debt", r"\bowed\b|\bdebt\b"),
    ("command", r"\bcommanded\b|\bordered\b"),
    ("membership", r"\bmember of\b|\bjoined\b"),
    ("ownership", r"\bowned\b|\bbelongs to\b"),
)
#: Phrases that contradict each other.
CONTRADICTIONS = (("will live", "will die"), ("will succeed", "will fail"), ("will return", "will never return"), ("is alive", "is dead"), ("will win", "will lose"), ("is good", "is evil"), ("is true", "is false"))
#: What a finding becomes in the review queue.
REVIEW_CATEGORIES = {"contradiction": "potential_contradiction", "alias": "ambiguous_entity", "entity_resolution": "ambiguous_entity", "er_ambiguity": "ambiguous_entity", "evidence_gate": "low_confidence_obligation", "schema": "low_confidence_obligation", "referential_integrity": "low_confidence_obligation"}
REVIEW_SEVERITIES = {"error": "high", "warn": "medium", "info": "low"}
