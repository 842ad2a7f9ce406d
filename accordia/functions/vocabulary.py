"""Fixed values of the citation vocabulary. Operators take them as parameters; these are the defaults."""

# Act names in the order in which they are looked for (a name may be part of a later one).
ACT_ALIASES = (
    ("ipc", "IPC"), ("indian penal code", "IPC"), ("bns", "BNS"), ("bharatiya nyaya sanhita", "BNS"), ("crpc", "CRPC"),
    ("code of criminal procedure", "CRPC"), ("bnss", "BNSS"), ("bharatiya nagarik suraksha sanhita", "BNSS"), ("bsa", "BSA"), ("bharatiya sakshya adhiniyam", "BSA"),
)
REPEALED_ACTS = ("IPC", "CRPC", "IEA")
CURRENT_ACTS = ("BNS", "BNSS", "BSA")

# A sentence with one of these reports a provision as superseded.
REPEAL_CUES = (
    "repeal", "supersed", "no longer", "erstwhile", "previously", "replaced", "stood repealed", "old provision", "ceased", "cease to", "w.e.f",
    "before the 2023", "before 1 july 2024", "used to", "earlier section", "formerly", "successor", "corresponding provision", "with effect from",
    "as amended", "now replaced", "in its place", "prior to", "renumbered",
)

# A sentence with one of these states the law that applies.
OPERATIVE_CUES = (
    "applies", "applied", "applicable", "governs", "governed", "charged", "liable", "convicted", "punishable", "in force", "would be", "shall be",
    "is the provision", "the provision is", "current provision",
)

# A text with one of these invokes another legal order; the first in this order counts.
FOREIGN_MARKERS = (
    "south african", "united kingdom", "english law", "uk ", "u.s.", "united states", "american", "canadian", "australian", "singapore", "nigerian",
    "kenyan", "malaysian", "bangladesh", "pakistani", "sri lankan", "new zealand", "common law jurisdictions", "most jurisdictions",
    "other jurisdictions", "many countries", "western jurisdictions", "criminal procedure act 51", "in the uk", "in the us",
)

# Cost of a wrong answer by harm class.
HARM_WEIGHTS = {"custodial": 5.0, "both": 3.0, "definition": 1.5, "procedural": 1.0, "unknown": 5.0}

# Verdicts that leave an answer undecided.
UNRESOLVED_LABELS = ("unresolved", "ambiguous", "no_provision_named", "only_superseded_mentioned")
