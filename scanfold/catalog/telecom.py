"""Telecommunications pack."""

from __future__ import annotations

from scanfold.catalog.model import WINDOW, Rule, pats

# --- Fixed values: TEL-001 -------------------------------------------------
DATA_RETENTION = Rule(
    rule_id="TEL-001",
    name="Data Retention Compliance",
    description="Detects potential data retention policy violations in telecom systems",
    severity="high",
    category="security",
    languages=("python", "javascript", "typescript", "java", "go"),
    cwe="CWE-1066",
    references=(
        "https://www.fcc.gov/general/telecommunications-act-1996",
        "https://cwe.mitre.org/data/definitions/1066.html",
    ),
    title="Telecom data stored without retention policy: {label}",
    message="Telecom data appears to be stored without a data retention policy. "
            "Regulatory requirements mandate specific retention periods for CDRs and other data.",
    flags="i",
    check=WINDOW,
    before=9,
    after=10,
    require=(r'call[_\s]?record', r'cdr', r'call[_\s]?log', r'sms[_\s]?log', r'message[_\s]?log',
             r'usage[_\s]?data', r'billing[_\s]?record', r'subscriber[_\s]?data', r'location[_\s]?data',
             r'cell[_\s]?tower', r'roaming[_\s]?data', r'network[_\s]?log', r'traffic[_\s]?data',
             r'session[_\s]?data'),
    suppress=(r'ttl', r'expir', r'retention', r'purge', r'cleanup', r'archive',
              r'delete[_\s]?after', r'max[_\s]?age'),
    patterns={
        "python": pats(
            (r'\.save\s*\(\s*\)', 'Database save without TTL'),
            (r'\.insert\s*\(', 'Database insert without TTL'),
            (r'\.create\s*\(', 'Record creation without retention'),
            (r'\.put\s*\(', 'Data put without expiration'),
        ),
        "javascript": pats(
            (r'\.save\s*\(', 'Database save without TTL'),
            (r'\.insert\w*\s*\(', 'Database insert without TTL'),
            (r'\.create\s*\(', 'Record creation without retention'),
            (r'\.set\s*\(', 'Data set without expiration'),
        ),
        "typescript": pats(
            (r'\.save\s*\(', 'Database save without TTL'),
            (r'\.insert\w*\s*\(', 'Database insert without TTL'),
            (r'\.create\s*\(', 'Record creation without retention'),
        ),
        "java": pats(
            (r'\.save\s*\(', 'Database save without TTL'),
            (r'\.persist\s*\(', 'Entity persist without retention'),
            (r'\.insert\s*\(', 'Database insert without TTL'),
        ),
        "go": pats(
            (r'\.Insert\s*\(', 'Database insert without TTL'),
            (r'\.Create\s*\(', 'Record creation without retention'),
            (r'\.Save\s*\(', 'Database save without TTL'),
        ),
    },
    pack="telecom",
)

# --- Fixed values: TEL-002 -------------------------------------------------
SUBSCRIBER_PRIVACY = Rule(
    rule_id="TEL-002",
    name="Subscriber Privacy Protection",
    description="Detects potential violations of subscriber privacy requirements",
    severity="critical",
    category="security",
    languages=("python", "javascript", "typescript", "java", "go"),
    owasp="A01:2021 - Broken Access Control",
    cwe="CWE-359",
    references=(
        "https://www.fcc.gov/consumers/guides/protecting-your-privacy",
        "https://cwe.mitre.org/data/definitions/359.html",
    ),
    title="Subscriber PII exposure: {label}",
    message="Subscriber personally identifiable information may be exposed without proper privacy protections.",
    flags="i",
    check=WINDOW,
    before=4,
    after=5,
    require=(r'phone[_\s]?number', r'mobile[_\s]?number', r'msisdn', r'imsi', r'imei',
             r'subscriber[_\s]?id', r'account[_\s]?number', r'billing[_\s]?address', r'home[_\s]?address',
             r'location[_\s]?data', r'gps[_\s]?coordinate', r'cell[_\s]?location', r'call[_\s]?history',
             r'contact[_\s]?list', r'voicemail'),
    suppress=(r'mask', r'redact', r'anonymize', r'sanitize', r'encrypt', r'hash', r'token',
              r'consent', r'authorize', r'permission'),
    patterns={
        "python": pats(
            (r'return\s+.*subscriber', 'Returning subscriber data'),
            (r'response\s*=.*subscriber', 'Including subscriber in response'),
            (r'json\.dumps\s*\(.*subscriber', 'Serializing subscriber data'),
            (r'print\s*\(.*subscriber', 'Printing subscriber data'),
        ),
        "javascript": pats(
            (r'res\.json\s*\(.*subscriber', 'Returning subscriber in response'),
            (r'res\.send\s*\(.*subscriber', 'Sending subscriber data'),
            (r'JSON\.stringify\s*\(.*subscriber', 'Serializing subscriber data'),
            (r'console\.\w+\s*\(.*subscriber', 'Logging subscriber data'),
        ),
        "typescript": pats(
            (r'res\.json\s*\(.*subscriber', 'Returning subscriber in response'),
            (r'res\.send\s*\(.*subscriber', 'Sending subscriber data'),
            (r'return\s+.*subscriber', 'Returning subscriber data'),
        ),
        "java": pats(
            (r'return\s+.*subscriber', 'Returning subscriber data'),
            (r'response\.getWriter.*subscriber', 'Writing subscriber to response'),
            (r'System\.out.*subscriber', 'Printing subscriber data'),
        ),
        "go": pats(
            (r'json\.Marshal\s*\(.*subscriber', 'Serializing subscriber data'),
            (r'fmt\.Print.*subscriber', 'Printing subscriber data'),
            (r'return\s+.*subscriber', 'Returning subscriber data'),
        ),
    },
    pack="telecom",
)

RULES = (DATA_RETENTION, SUBSCRIBER_PRIVACY)
