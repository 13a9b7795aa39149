"""Healthcare (HIPAA) pack."""

from __future__ import annotations

from scanfold.catalog.model import ANY, WINDOW, Rule, pats

# --- Fixed values: HIPAA-001 -----------------------------------------------
PHI_WORDS = (
    r'patient[_\s]?name', r'patient[_\s]?id', r'medical[_\s]?record', r'mrn', r'ssn',
    r'social[_\s]?security', r'date[_\s]?of[_\s]?birth', r'dob', r'diagnosis', r'treatment',
    r'prescription', r'health[_\s]?record', r'insurance[_\s]?id', r'policy[_\s]?number',
    r'beneficiary', r'medical[_\s]?history', r'lab[_\s]?result', r'test[_\s]?result',
    r'blood[_\s]?type', r'allergy', r'medication', r'pharmacy', r'physician',
    r'doctor[_\s]?name', r'provider[_\s]?id', r'npi', r'encounter', r'admission', r'discharge',
)
PHI_LOGGING = Rule(
    rule_id="HIPAA-001",
    name="PHI Logging Prevention",
    description="Detects potential Protected Health Information (PHI) being logged or printed",
    severity="critical",
    category="security",
    languages=("python", "javascript", "typescript", "java", "csharp", "go"),
    owasp="A09:2021 - Security Logging and Monitoring Failures",
    cwe="CWE-532",
    references=(
        "https://www.hhs.gov/hipaa/for-professionals/security/laws-regulations/index.html",
        "https://cwe.mitre.org/data/definitions/532.html",
        "https://cheatsheetseries.owasp.org/cheatsheets/Logging_Cheat_Sheet.html",
    ),
    title="Potential PHI being logged",
    message="Detected potential PHI field '{detail}' being logged. Logging PHI violates HIPAA regulations.",
    flags="i",
    check=WINDOW,
    require=PHI_WORDS,
    detail_words=PHI_WORDS,
    patterns={
        "python": pats(r'print\s*\(', r'logging\.\w+\s*\(', r'logger\.\w+\s*\('),
        "javascript": pats(r'console\.\w+\s*\(', r'logger\.\w+\s*\('),
        "typescript": pats(r'console\.\w+\s*\(', r'logger\.\w+\s*\('),
        "java": pats(r'System\.out\.print', r'logger\.\w+\s*\(', r'log\.\w+\s*\('),
        "csharp": pats(r'Console\.Write', r'_logger\.\w+\s*\(', r'Log\.\w+\s*\('),
        "go": pats(r'fmt\.Print', r'log\.\w+\s*\('),
    },
    pack="healthcare",
)

# --- Fixed values: HIPAA-002 -----------------------------------------------
PHI_ENCRYPTION = Rule(
    rule_id="HIPAA-002",
    name="PHI Encryption Required",
    description="Detects PHI data that may be stored or transmitted without encryption",
    severity="critical",
    category="security",
    languages=("python", "javascript", "typescript", "java", "csharp", "go"),
    owasp="A02:2021 - Cryptographic Failures",
    cwe="CWE-311",
    references=(
        "https://www.hhs.gov/hipaa/for-professionals/security/guidance/"
        "guidance-risk-analysis-requirements/index.html",
        "https://cwe.mitre.org/data/definitions/311.html",
    ),
    title="PHI may be stored without encryption: {label}",
    message="Detected potential PHI data being stored or transmitted without encryption. "
            "HIPAA requires encryption for PHI at rest and in transit.",
    flags="i",
    check=WINDOW,
    before=4,
    after=5,
    require=(r'patient', r'medical', r'health', r'diagnosis', r'treatment',
             r'ssn', r'dob', r'mrn', r'insurance', r'prescription'),
    patterns={
        "python": pats(
            (r'open\s*\([^)]+["\']w["\']', 'Writing to file without encryption'),
            (r'json\.dump\s*\(', 'Storing JSON without encryption'),
            (r'pickle\.dump\s*\(', 'Storing pickle without encryption'),
            (r'sqlite3\.connect', 'SQLite database (consider encryption)'),
        ),
        "javascript": pats(
            (r'localStorage\.setItem', 'Storing in localStorage (unencrypted)'),
            (r'sessionStorage\.setItem', 'Storing in sessionStorage'),
            (r'fs\.writeFile', 'Writing to file without encryption'),
            (r'indexedDB\.open', 'IndexedDB storage (consider encryption)'),
        ),
        "typescript": pats(
            (r'localStorage\.setItem', 'Storing in localStorage (unencrypted)'),
            (r'sessionStorage\.setItem', 'Storing in sessionStorage'),
            (r'fs\.writeFile', 'Writing to file without encryption'),
        ),
        "java": pats(
            (r'FileOutputStream', 'File output without encryption'),
            (r'ObjectOutputStream', 'Object serialization without encryption'),
            (r'SharedPreferences', 'SharedPreferences (Android - unencrypted)'),
        ),
    },
    pack="healthcare",
)

# --- Fixed values: HIPAA-003 -----------------------------------------------
PHI_AUDIT_TRAIL = Rule(
    rule_id="HIPAA-003",
    name="PHI Audit Trail Required",
    description="Detects PHI access without proper audit logging",
    severity="high",
    category="security",
    languages=("python", "javascript", "typescript", "java"),
    owasp="A09:2021 - Security Logging and Monitoring Failures",
    cwe="CWE-778",
    references=(
        "https://www.hhs.gov/hipaa/for-professionals/security/guidance/index.html",
        "https://cwe.mitre.org/data/definitions/778.html",
    ),
    title="PHI access without audit trail: {label}",
    message="Detected {label} without apparent audit logging. HIPAA requires audit trails for all PHI access.",
    flags="i",
    check=WINDOW,
    before=9,
    after=10,
    suppress=(r'audit[_\s]?log', r'log[_\s]?audit', r'audit[_\s]?trail', r'access[_\s]?log',
              r'phi[_\s]?audit', r'hipaa[_\s]?log', r'compliance[_\s]?log'),
    patterns={
        ANY: pats(
            (r'get[_\s]?patient', 'Patient data access'),
            (r'fetch[_\s]?medical', 'Medical record fetch'),
            (r'read[_\s]?health', 'Health record read'),
            (r'query[_\s]?patient', 'Patient data query'),
            (r'load[_\s]?medical', 'Medical record load'),
            (r'retrieve[_\s]?phi', 'PHI retrieval'),
            (r'access[_\s]?record', 'Record access'),
            (r'view[_\s]?patient', 'Patient view'),
            (r'download[_\s]?medical', 'Medical download'),
            (r'export[_\s]?health', 'Health data export'),
        ),
    },
    pack="healthcare",
)

RULES = (PHI_LOGGING, PHI_ENCRYPTION, PHI_AUDIT_TRAIL)
