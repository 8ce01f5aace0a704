"""Keyword families, checklists and word lists that decide labels."""

#: Clause-type families, in the order in which they are tried.
CLAUSE_FAMILIES = (
    ("Definitions", ("definition", "interpretation")),
    ("Termination", ("termination", "terminate", "cancellation")),
    ("Confidentiality", ("confidential", "non-disclosure", "secrecy")),
    ("Payment", ("payment", "purchase price", "consideration", "fees", "remuneration")),
    ("Intellectual Property", ("intellectual property", "copyright", "trade mark", "trademark", "patent")),
    ("Indemnity", ("indemnif", "indemnity", "hold harmless")),
    ("Warranties", ("warrant", "representation")),
    ("Force Majeure", ("force majeure", "act of god", "vis major", "casus fortuitus")),
    ("Dispute Resolution", ("dispute", "arbitration", "mediation")),
    ("Governing Law", ("governing law", "governed by", "applicable law")),
    ("Notices", ("notice", "domicilium", "domicilia")),
    ("Breach", ("breach", "default", "remedies")),
    ("Restraint of Trade", ("restraint", "non-compete", "non-solicit")),
    ("Assignment", ("assignment", "cession", "delegation")),
    ("Limitation of Liability", ("limitation of liability", "liability cap", "exclusion of liability")),
    ("Data Protection", ("popia", "data protection", "personal information", "gdpr", "privacy")),
    ("Insurance", ("insurance", "insure")),
    ("General", ("whole agreement", "entire agreement", "severability", "counterparts", "variation")),
)
#: Contract-type families, in order.
CONTRACT_FAMILIES = (
    ("Share Purchase Agreement", ("share purchase", "sale of shares", "spa")),
    ("Non-Disclosure Agreement", ("non-disclosure", "nondisclosure", "confidentiality agreement", "nda")),
    ("Loan Agreement", ("loan agreement", "facility agreement", "credit agreement")),
    ("Lease Agreement", ("lease agreement", "agreement of lease", "rental agreement")),
    ("Employment Agreement", ("employment agreement", "contract of employment", "employment contract")),
    ("Service Agreement", ("services agreement", "service agreement", "master services", "consulting agreement")),
    ("Shareholders Agreement", ("shareholders agreement", "shareholders' agreement")),
    ("Sale Agreement", ("sale agreement", "purchase agreement", "sale of business")),
    ("Memorandum of Incorporation", ("memorandum of incorporation", "moi")),
    ("Joint Venture Agreement", ("joint venture",)),
    ("Supply Agreement", ("supply agreement",)),
    ("Licence Agreement", ("licence agreement", "license agreement", "licensing agreement")),
)
JURISDICTIONS = (
    ("South Africa", ("republic of south africa", "south africa", "laws of south africa", "popia")),
    ("England and Wales", ("england and wales", "english law")),
    ("United States", ("state of delaware", "state of new york", "state of california", "united states")),
    ("Namibia", ("republic of namibia",)),
    ("Botswana", ("republic of botswana",)),
)
INSTRUMENTS = ("agreement", "contract", "deed", "charter", "charterparty", "lease", "licence", "license", "memorandum", "mandate", "policy", "terms", "undertaking", "addendum", "amendment")
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "in", "nor", "of", "on", "or", "the", "to", "up", "via", "with")
#: Required and optional clause types of the contract types that have a checklist.
CHECKLISTS = {
    "Non-Disclosure Agreement": (("Definitions", "Confidentiality", "Breach", "Termination", "Governing Law", "Notices"), ("Data Protection", "Dispute Resolution", "General")),
    "Share Purchase Agreement": (("Definitions", "Payment", "Warranties", "Indemnity", "Confidentiality", "Breach", "Termination", "Governing Law", "Notices"), ("Restraint of Trade", "Dispute Resolution", "General")),
    "Loan Agreement": (("Definitions", "Payment", "Warranties", "Breach", "Governing Law", "Notices"), ("Insurance", "Indemnity", "Dispute Resolution", "General")),
    "Employment Agreement": (("Definitions", "Payment", "Confidentiality", "Restraint of Trade", "Termination", "Governing Law", "Notices"), ("Intellectual Property", "Data Protection", "General")),
    "Service Agreement": (("Definitions", "Payment", "Warranties", "Limitation of Liability", "Confidentiality", "Termination", "Governing Law", "Notices"), ("Intellectual Property", "Indemnity", "Data Protection", "General")),
    "Lease Agreement": (("Definitions", "Payment", "Breach", "Termination", "Governing Law", "Notices"), ("Insurance", "General")),
}
#: Order for contract types without a checklist.
GENERIC_ORDER = ("Definitions", "Payment", "Warranties", "Indemnity", "Intellectual Property", "Confidentiality", "Limitation of Liability", "Restraint of Trade", "Insurance", "Assignment", "Breach", "Termination", "Force Majeure", "Data Protection", "Dispute Resolution", "Governing Law", "Notices", "General")
#: Pairs of clause types that exclude each other: none is known.
CONFLICTS: tuple[tuple[str, str], ...] = ()
ENTITY_SUFFIXES = ("ltd", "limited", "inc", "incorporated", "llc", "llp", "plc", "cc", "gmbh", "sa", "spa")
EXTENSIONS = ("docx", "pdf", "txt", "md", "html", "htm")
EXECUTION_WORDS = ("signature", "signed", "execution")
RECITAL_WORDS = ("recital", "preamble", "introduction", "whereas", "background")
SUBSTANTIVE_RECITAL = ("recital", "preamble", "background", "introduction")
