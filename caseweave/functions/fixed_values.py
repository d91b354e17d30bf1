"""Word lists, aliases, patterns and thresholds that define results.

Everything in this module is data.  The values are part of the published
behaviour (they decide which text matches and how ids are formed), so they are
kept together, in plain text, and imported by the operators.
"""

# --- fixed values: identifier patterns (kind, pattern, capture group) ---------
IDENTIFIER_PATTERNS = [
    ("Phone", r"(?<!\w)(?:\+91[- ]?|0)?[6-9]\d{9}\b", 0),
    ("Vehicle", r"\b[A-Z]{2}[- ]?\d{1,2}[- ]?[A-Z]{1,3}[- ]?\d{4}\b", 0),
    ("Account", r"\b(?:account(?:\s*(?:number|no\.?))?|a/c)\s*[:#-]?\s*(\d{9,18})\b", 1),
    ("UPI", r"\b[a-zA-Z0-9.\-_]{2,64}@[a-zA-Z]{2,32}\b", 0),
    ("IMEI", r"\bIMEI\s*[:#-]?\s*(\d{15})\b", 1),
]

# --- fixed values: forms of identifiers ------------------------------------------
PHONE_NOISE = r"[\s\-().]"
PHONE_NATIONAL = r"^(?:\+91|91|0)?([6-9]\d{9})$"
PHONE_PREFIX = "+91"
PHONE_INTERNATIONAL = r"^\+[1-9]\d{6,14}$"
GROUPING = r"[\s\-]"
VEHICLE_FORM = r"^(?:[A-Z]{2}\d{1,2}[A-Z]{1,3}\d{4}|\d{2}BH\d{4}[A-Z]{1,2})$"
UPI_FORM = r"^[a-z0-9.\-_]{2,64}@[a-z]{2,32}$"
ACCOUNT_DIGITS = r"^\d{9,18}$"
ACCOUNT_REFERENCE = r"^(?=.*\d)[A-Z0-9/_\-]{4,20}$"
IFSC_FORM = r"^[A-Z]{4}0[A-Z0-9]{6}$"
CALL_NUMBER_FORM = r"^\+?[\d ()-]+$"
CASE_ID_FORM = r"^[A-Za-z0-9_-]{1,100}$"

# --- fixed values: quality warnings -----------------------------------------------
NO_RELATIONSHIP = ("Entities extracted; no explicit relationships validated. "
                   "Co-occurrence does not establish a relationship.")
NEEDS_MAPPING = ("Unrecognized table columns need a source mapping; automatic call/bank mapping "
                 "requires standard headers.")
NO_SCHEMA = "No registry schema detected. Ensure column headers match expected names."

# --- fixed values: label vocabulary --------------------------------------------
HONORIFICS = r"^(?:mr|mrs|ms|dr|shri|smt|prof|adv|inspector|constable|si|asi|acp|dcp|dsp|hc|officer)\.?\s+"

STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up",
    "about", "into", "over", "after", "beneath", "under", "above", "this", "that", "these", "those", "it", "its",
    "they", "them", "their", "we", "us", "our", "you", "your", "he", "him", "his", "she", "her", "who", "whom",
    "which", "what", "where", "when", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "will",
    "just", "should", "now", "also", "then", "there", "here",
]

BOILERPLATE = [
    "draft", "working", "working draft", "problem", "problem statement", "context", "architecture", "risk",
    "register", "data plan", "evaluation plan", "evaluation", "formal statement", "design principles",
    "decision", "system", "research claim", "research", "claim", "scope", "section", "table", "figure",
    "annexure", "item", "total", "status", "summary", "report", "document", "dataset", "module", "study",
    "matrix", "model", "models", "method", "methods", "algorithm", "parameter", "score", "scores", "precision",
    "recall", "baseline", "framework", "analysis", "intelligence", "analytics", "layer", "layers", "ontology",
    "schema", "pipeline", "ablation", "loss", "accuracy", "node", "nodes", "edge", "edges", "graph", "graphs",
    "network", "networks", "link", "links", "connection", "connections", "source", "sources", "target",
    "targets", "evidence", "hypothesis", "hypotheses", "investigator", "officer", "accused", "suspect",
    "witness", "victim", "complainant", "police", "court", "judge", "lawyer", "driver", "hotel", "family",
    "someone", "anyone", "none", "etc", "case", "cases", "page", "pages", "level", "levels", "task", "tasks",
    "gap", "gaps", "fix", "gnn", "lstm", "gat", "graphsage", "envit", "cnis", "firs", "fir", "cdrs", "cdr",
    "bns", "ipc", "aadhaar", "node2vec", "katz", "muril", "indicbert", "paysim", "amlsim", "amlworld",
    "elliptic bitcoin",
]

SECTION_PREFIXES = ["section ", "table ", "figure ", "page ", "annexure ", "article ", "clause ",
                    "item ", "draft ", "version ", "part ", "chapter "]
LABEL_EDGE_PUNCTUATION = "•-*_~`#()[]{}|/\\:;,.\"'"
NUMBERING_SHAPE = r"(?i)^(?:v?\d+(?:\.\d+)*+|[A-Za-z]\d{1,3}|(?:\d+(?:st|nd|rd|th)))$"

# --- fixed values: sentence and clause grammar ---------------------------------
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "shri", "smt", "rs", "no", "vs", "v", "st", "prof"]
UNSAFE = (r"\b(?:not|never|no|denied|denies|alleged|allegedly|might|may|could|if|said|says|claimed|"
          r"claims|whether|didn't|doesn't|wasn't|isn't|cannot|can't)\b")
ATTRIBUTION = r"\b(?:said|says|claimed|claims|stated|submitted|reported|alleged|allegedly)\b"
NEGATED = (r"\b(?:not|never|denied|denies|might|may|could|if|whether|didn't|doesn't|wasn't|isn't|"
           r"cannot|can't)\b")
UNCONFIRMED = r"\b(?:unconfirmed|unverified|disputed|uncertain|false)\b"
ASSET = (r"(?:the\s+)?(?:mobile\s+|telephone\s+)?(?:phone|vehicle|account|a/c|IMEI)"
         r"(?:\s+(?:number|no\.?))?\s*[:#-]?\s*")
MONTH_DAY = (r"(?:january|february|march|april|may|june|july|august|september|october|november|"
             r"december|monday|tuesday|wednesday|thursday|friday|saturday|sunday|today|yesterday|"
             r"morning|afternoon|evening|night|noon|midnight)")
TIME_TOKEN = (r"(?:\d{1,4}(?:[-/.]\d{1,4}){0,2}|\d{1,2}:\d{2}(?::\d{2})?|am|pm|" + MONTH_DAY + r"|the|of)")
# the look-ahead and the possessive repeat keep long runs of time words iterative
TEMPORAL_PREFIX = (r"(?:on|at|during|in|before|after)\s+" + TIME_TOKEN + r"(?:\s+" + TIME_TOKEN
                   + r"(?=\s*[,;:]?\s))*+\s*[,;:]?\s+")
DAY_PREFIX = (r"(?:today|yesterday|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
              r"\s*[,;:]\s+")
SOURCE_NOUN = (r"(?:records?|call\s+(?:logs?|records?)|reports?|witness|complainant|investigator|"
               r"officer|statement|FIR|evidence|document)")
REPORT_PREFIX = (r"(?:(?:the\s+)?" + SOURCE_NOUN + r"\s+(?:show(?:ed|s)?|indicate(?:d|s)?|"
                 r"state(?:d|s)?|report(?:ed|s)?|record(?:ed|s)?|confirm(?:ed|s)?|say|says|said|"
                 r"claimed|claims|submitted)\s+(?:that\s+)?|according\s+to\s+(?:the\s+)?"
                 + SOURCE_NOUN + r"\s*[,;:]?\s+)")
ROLE_PREFIX = r"(?:the\s+)?(?:accused|suspect|witness|victim|complainant|officer)\s+"
CLAUSE_BOUNDARY = r"(?:;|,\s*(?:and|but|while|whereas)\s+)"
FOLLOWING_CLAUSE = r"(?:;|,?\s+(?:and|but|while|whereas)\b)"
FOLLOWING_QUALIFIER = (r"\s*[,;]?\s*(?:and|but)\s+(?:(?:this|that|it|the\s+(?:call|contact|meeting|"
                       r"statement))\b|(?:allegedly|may|might|could|denied|denies)\b)")
IDENTIFIER_LABEL = (r"\b((?:mobile\s+|telephone\s+)?(?:phone|vehicle|account|a/c|IMEI))\s+"
                    r"(?:number|no\.?)\s*[:#-]?\s*")

# --- fixed values: quote validation grammar ------------------------------------
QUOTE_NEGATED = (r"\b(?:not|never|denied|denies|didn't|doesn't|wasn't|weren't|isn't|aren't|"
                 r"cannot|can't|couldn't|hasn't|haven't|hadn't|won't|wouldn't)\b|"
                 r"\bno\s+(?:evidence|connection|contact|relationship|meeting|call)\b")
QUOTE_UNCERTAIN = (r"\b(?:might|could|whether|if|unclear|uncertain|unconfirmed|unverified|disputed)\b|"
                   r"\bmay\s+(?:have|be|call|contact|meet|use|own|transfer|live|work|travel)\b")
QUOTE_ATTRIBUTED = (r"\b(?:said|says|claimed|claims|stated|submitted|reported|alleged|allegedly|"
                    r"testified|testifies|according\s+to)\b")
RELATED_CONTEXT = (r"\b(?:this|that|the)\s+(?:claim|allegation|statement|account|report|assertion|call|"
                   r"meeting|contact|relationship)\b")
SOURCE_PREFIX = (r"^\s*According\s+to\b[^.!?]{0,180}\b(?:statement|testimony|report|complaint|account)"
                 r"\s*[.:]?\s*$")
PROPOSAL_TYPES = [
    "CALLED", "CONTACTED", "MET", "USES", "OWNS", "REGISTERED_TO", "TRANSFERRED_TO", "WORKS_FOR", "MEMBER_OF",
    "RESIDES_IN", "LOCATED_IN", "ASSOCIATED_WITH", "CHILD_OF", "SIBLING_OF", "SPOUSE_OF", "POSTED_AT",
    "REPORTED", "SEEN_WITH", "TRAVELLED_WITH",
]
CHUNK_SIZE = 10000
CHUNK_OVERLAP = 1000
MARKER_CHARS = 80
# a window ends behind a stop with its white space, or behind a blank line
CHUNK_ENDS = [r"[.!?](?:\s+|\z)", r"\n\s*\n"]

# --- fixed values: header aliases ----------------------------------------------
CALL_ALIASES = {
    "caller": [
        "callerid", "caller", "callernumber", "callerphone", "from", "fromnumber", "source", "sourcenumber",
        "anumber",
    ],
    "receiver": [
        "receiverid", "receiver", "receivernumber", "receiverphone", "callee", "calleenumber", "to", "tonumber",
        "destination", "destinationnumber", "bnumber",
    ],
    "timestamp": ["timestamp", "datetime", "calltime", "calldatetime"],
    "duration": ["durationsec", "durationseconds", "duration", "callduration"],
    "callType": ["calltype", "direction"],
    "cellTower": ["celltower", "towerid", "celltowerid"],
    "sourceCaseId": ["caseid", "case"],
    "callId": ["callid", "recordid"],
}
BANK_ALIASES = {
    "from_account": [
        "fromaccount", "fromaccountno", "senderaccount", "sourceaccount", "debitaccount", "fromacc",
        "payeraccount", "fromaccountid",
    ],
    "to_account": [
        "toaccount", "toaccountno", "beneficiaryaccount", "receiveraccount", "creditaccount", "toacc",
        "payeeaccount", "beneficiary", "toaccountid",
    ],
    "amount": ["amount", "txnamount", "transactionamount", "debitamount", "creditamount", "value"],
    "currency": ["currency", "curr", "ccy"],
    "timestamp": ["timestamp", "datetime", "txndate", "transactiondate", "date", "valuedate"],
    "txn_type": ["type", "txntype", "paymentmode", "method", "channel", "mode"],
    "reference": ["utr", "refno", "referencenumber", "txnid", "transactionid", "chequeno"],
}
# Registry schemas in detection order: required roles, then role -> header names.
REGISTRY_REQUIRED = {
    "accounts": ["account_number", "holder_id"],
    "kyc": ["person_id", "name"],
    "company_registry": ["company_id", "company_name"],
    "company_directors": ["company_id", "person_id", "role"],
    "vehicles": ["vehicle_id", "reg_number", "owner_id"],
    "vehicle_events": ["vehicle_id", "event_type", "location_id"],
    "locations": ["location_id", "city"],
    "cyber_events": ["source_entity_id", "event_type", "ip_address"],
    "emails": ["sender", "receiver"],
    "ip_events": ["ip_address", "person_id", "event_type"],
    "domains": ["domain"],
}
REGISTRY_ALIASES = {
    "accounts": {
        "account_id": ["accountid", "accid"],
        "account_number": ["accountnumber", "accountno", "accno", "accountnum"],
        "holder_id": ["holderid", "personid", "ownerid"],
        "holder_type": ["holdertype"],
        "upi_id": ["upiid", "vpa"],
        "bank_id": ["bankid", "bank"],
        "account_type": ["accounttype"],
    },
    "kyc": {
        "person_id": ["personid"],
        "name": ["nameasreported", "name", "fullname"],
        "phone": ["phoneasreported", "phone", "mobile", "phonenumber"],
        "email": ["emailasreported", "email", "emailid"],
        "national_id": ["nationalid", "aadhaar", "aadhaarnumber"],
        "dob": ["dateofbirth", "dob"],
        "address": ["addressasreported", "address"],
    },
    "company_registry": {
        "company_id": ["companyid"],
        "company_name": ["companyname", "name"],
        "reg_number": ["registrationnumber", "regno", "cin"],
        "company_type": ["companytype", "type"],
        "bank_account_id": ["primarybankaccountid", "bankaccountid", "accountid"],
        "address_id": ["registeredaddressid", "addressid"],
    },
    "company_directors": {
        "company_id": ["companyid"],
        "person_id": ["personid"],
        "role": ["role", "designation", "position"],
        "start_date": ["startdate", "appointmentdate"],
    },
    "vehicles": {
        "vehicle_id": ["vehicleid"],
        "reg_number": ["registrationnumber", "plate", "vehicleplate", "licenseplate"],
        "owner_id": ["ownerpersonid", "ownerid"],
        "vehicle_type": ["vehicletype", "type"],
        "make": ["make", "brand"],
        "model": ["model"],
        "year": ["year", "manufactureyear"],
    },
    "vehicle_events": {
        "event_id": ["eventid"],
        "vehicle_id": ["vehicleid"],
        "timestamp": ["timestamp", "datetime", "eventtime"],
        "location_id": ["locationid", "locid"],
        "event_type": ["eventtype"],
        "source_id": ["sourceid"],
    },
    "locations": {
        "location_id": ["locationid", "locid"],
        "name": ["name"],
        "city": ["city"],
        "state": ["state"],
        "country": ["country"],
        "lat": ["latitude", "lat"],
        "lon": ["longitude", "lon", "lng"],
        "address": ["addresstext", "address"],
        "loc_type": ["locationtype"],
    },
    "cyber_events": {
        "event_id": ["eventid"],
        "timestamp": ["timestamp", "datetime", "eventtime"],
        "event_type": ["eventtype"],
        "source_entity_id": ["sourceentityid", "personid"],
        "target_entity_id": ["targetentityid"],
        "ip_address": ["ipaddress", "ip", "ipid"],
        "device_id": ["deviceid"],
        "domain_name": ["domainname", "domain"],
        "outcome": ["outcome", "result"],
    },
    "emails": {
        "event_id": ["emaileventid", "eventid"],
        "timestamp": ["timestamp", "datetime", "eventtime"],
        "sender": ["senderemail", "sender", "fromemail"],
        "receiver": ["receiveremail", "receiver", "toemail", "recipient"],
        "domain": ["domain"],
        "ip_address": ["ipaddress", "ip"],
    },
    "ip_events": {
        "ip_event_id": ["ipeventid", "eventid"],
        "timestamp": ["timestamp", "datetime", "eventtime"],
        "ip_address": ["ipaddress", "ip"],
        "person_id": ["personid"],
        "device_id": ["deviceid"],
        "event_type": ["eventtype"],
    },
    "domains": {
        "domain_id": ["domainid"],
        "domain": ["domain", "domainname"],
        "registrar": ["registrar"],
        "status": ["status"],
    },
}

# --- fixed values: report forms -------------------------------------------------
FORM_NUMBER = (r"(?i)\b(?:FIR\s*(?:No\.?|Number)|First\s*Information\s*Report\s*No\.?)\s*[:\-\s]+\s*"
               r"([A-Z0-9\-_/]+)")
FORM_OFFICER = (r"(?i)(?:Investigating[^\S\n]*Officer|I\.?O\.?|Complainant|Informant)(?:[:\-]|[^\S\n])+"
                r"(?:Inspector|Constable|Sub-Inspector|SI|ASI)?[^\S\n]*([A-Z][a-zA-Z\. ]{2,30})")
FORM_OFFICER_NOISE = ["fictional", "demonstration", "synthetic", "unit"]
FORM_PERSON_LINE = r"^(?:(?:ENT|ACC|PER|ORG|ACCUSED|ID)[-_]?\d*\s+)?([A-Z][a-zA-Z\s\.]{2,35})\s{2,}(.+)$"
FORM_HEADER_WORDS = [
    "important", "fir number", "case id", "police station", "investigation type", "classification",
    "investigating officer", "source id", "date/time", "date", "field", "synthetic value",
    "source type", "analyst note", "first information report", "other contacts",
    "synthetic observation", "evidence references", "persons mentioned"]
FORM_ORG_WORDS = ["exports", "trust", "logistics", "pvt", "ltd", "corp", "bank", "enterprises"]
FORM_ACCUSED_WORDS = ["accused", "suspect", "primary"]
FORM_GROUP = (r"(?i)(?:repeated|frequent|multiple)?\s*(?:calls|communications|transfers|meetings)\s*"
              r"(?:among|between)\s+([A-Z][a-zA-Z\s,]+(?:and\s+[A-Z][a-zA-Z\s]+)?)")

# --- fixed values: display ------------------------------------------------------
EDGE_LABELS = {
    "CALLED": "called", "CONTACTED": "contacted", "MET": "met", "ASSOCIATED_WITH": "connected to",
    "CHILD_OF": "child of", "SIBLING_OF": "sibling of", "SPOUSE_OF": "spouse of",
    "POSTED_AT": "posted at", "WORKS_FOR": "works for", "MEMBER_OF": "member of",
    "RESIDES_IN": "lives in", "LOCATED_IN": "located in", "USES": "uses", "OWNS": "owns",
    "REGISTERED_TO": "registered to", "TRANSFERRED_TO": "transferred to",
    "COMMUNICATED_WITH": "communicated with", "MESSAGED": "messaged", "PRESENT_AT": "present at",
    "VISITED": "visited", "PAID": "paid", "RECEIVED_FROM": "received from", "OPERATES": "operates",
    "ACCUSED_IN": "accused in", "INVOLVED_IN": "involved in",
}
ALLOWED_EXTENSIONS = [".pdf", ".docx", ".txt", ".csv", ".tsv", ".xlsx"]
MAX_UPLOAD_BYTES = 1024 * 1024 * 1024
MIN_TEXT_CHARS = 15
BUSY_STATUSES = ["storing", "pending", "processing"]
REFERENCE_COLLECTIONS = ["ref_accounts", "ref_kyc", "ref_companies", "ref_directors", "ref_vehicles",
                         "ref_vehicle_events", "ref_cyber_events", "ref_locations"]
COMPONENT_VERSIONS = ["source-v3", "gazetteer-entities", "regex-relations-v3", "structured-calls-v2",
                      "structured-registry-v1", "quote-relations-v2"]
