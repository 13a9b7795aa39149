"""Government (FedRAMP) pack."""

from __future__ import annotations

from scanfold.catalog.model import ANY, CIPHER, GLUED, WINDOW, Rule, pats

_LANGUAGES = ("python", "javascript", "typescript", "java", "go", "csharp")

# --- Fixed values: FED-001 -------------------------------------------------
ACCESS_CONTROL = Rule(
    rule_id="FED-001",
    name="FedRAMP Access Control",
    description="Detects missing or improper access control in government systems",
    severity="critical",
    category="security",
    languages=_LANGUAGES,
    owasp="A01:2021 - Broken Access Control",
    cwe="CWE-284",
    references=(
        "https://www.fedramp.gov/",
        "https://nvd.nist.gov/800-53",
        "https://cwe.mitre.org/data/definitions/284.html",
    ),
    title="Missing access control: {label}",
    message="API endpoint or sensitive operation detected without apparent access control. "
            "FedRAMP requires strict access control (AC controls).",
    flags="i",
    check=GLUED,
    before=9,
    after=3,
    suppress=(r'@require[_\s]?auth', r'@authenticate', r'@authorize', r'@permission', r'@role',
              r'@protected', r'@guard', r'middleware.*auth', r'check[_\s]?permission',
              r'verify[_\s]?token', r'validate[_\s]?session', r'is[_\s]?authorized',
              r'has[_\s]?permission', r'rbac', r'acl', r'policy', r'\.authorize\s*\(',
              r'UseAuthorization', r'RequireAuthorization', r'AllowAnonymous'),
    patterns={
        "python": pats(
            (r'@app\.(?:get|post|put|delete|patch)\s*\(["\'][^"\']+["\']', 'FastAPI/Flask endpoint'),
            (r'@router\.(?:get|post|put|delete|patch)\s*\(["\'][^"\']+["\']', 'Router endpoint'),
            (r'def\s+(?:get|post|put|delete|patch|create|update|remove)\w*\s*\(', 'CRUD operation'),
        ),
        "javascript": pats(
            (r'app\.(?:get|post|put|delete|patch)\s*\(["\'][^"\']+["\']', 'Express endpoint'),
            (r'router\.(?:get|post|put|delete|patch)\s*\(["\'][^"\']+["\']', 'Router endpoint'),
            (r'async\s+function\s+(?:get|post|put|delete|create|update|remove)\w*\s*\(', 'Async handler'),
        ),
        "typescript": pats(
            (r'@(?:Get|Post|Put|Delete|Patch)\s*\(["\'][^"\']*["\']?\)', 'NestJS endpoint'),
            (r'app\.(?:get|post|put|delete|patch)\s*\(["\'][^"\']+["\']', 'Express endpoint'),
            (r'router\.(?:get|post|put|delete|patch)\s*\(["\'][^"\']+["\']', 'Router endpoint'),
        ),
        "java": pats(
            (r'@(?:Get|Post|Put|Delete|Patch)Mapping\s*\(', 'Spring endpoint'),
            (r'@RequestMapping\s*\(', 'Request mapping'),
            (r'public\s+\w+\s+(?:get|post|put|delete|create|update|remove)\w*\s*\(', 'Handler method'),
        ),
        "go": pats(
            (r'\.(?:GET|POST|PUT|DELETE|PATCH)\s*\(["\'][^"\']+["\']', 'HTTP handler'),
            (r'func\s+\w*(?:Get|Post|Put|Delete|Create|Update|Remove)\w*\s*\(', 'Handler function'),
        ),
        "csharp": pats(
            (r'\[Http(?:Get|Post|Put|Delete|Patch)\]', '.NET endpoint'),
            (r'public\s+\w+\s+(?:Get|Post|Put|Delete|Create|Update|Remove)\w*\s*\(', 'Controller action'),
        ),
    },
    pack="government",
)

# --- Fixed values: FED-002 -------------------------------------------------
SECURITY_EVENTS = Rule(
    rule_id="FED-002",
    name="FedRAMP Audit Logging",
    description="Detects missing audit logging for security-relevant events",
    severity="high",
    category="security",
    languages=_LANGUAGES,
    owasp="A09:2021 - Security Logging and Monitoring Failures",
    cwe="CWE-778",
    references=(
        "https://www.fedramp.gov/",
        "https://nvd.nist.gov/800-53/Rev4/control/AU-2",
        "https://cwe.mitre.org/data/definitions/778.html",
    ),
    title="Missing audit log: {label}",
    message="Security-relevant event ({label}) detected without apparent audit logging. "
            "FedRAMP requires comprehensive audit logging.",
    flags="i",
    check=WINDOW,
    before=4,
    after=5,
    suppress=(r'audit[_\s]?log', r'security[_\s]?log', r'log[_\s]?event', r'event[_\s]?log',
              r'\.audit\s*\(', r'\.security\s*\(', r'AuditLogger', r'SecurityLogger',
              r'emit[_\s]?event', r'record[_\s]?event', r'track[_\s]?event'),
    patterns={
        ANY: pats(
            (r'login|sign[_\s]?in|authenticate', 'Authentication event'),
            (r'logout|sign[_\s]?out', 'Logout event'),
            (r'password.*(?:change|reset|update)', 'Password change'),
            (r'permission.*(?:grant|revoke|change)', 'Permission change'),
            (r'role.*(?:assign|remove|change)', 'Role change'),
            (r'delete.*(?:user|account|record)', 'Deletion event'),
            (r'admin|administrator|superuser', 'Admin action'),
            (r'access[_\s]?denied|unauthorized|forbidden', 'Access denial'),
            (r'failed.*(?:login|auth|attempt)', 'Failed attempt'),
            (r'token.*(?:create|revoke|expire)', 'Token lifecycle'),
            (r'api[_\s]?key.*(?:create|delete|rotate)', 'API key management'),
            (r'config.*(?:change|update|modify)', 'Configuration change'),
            (r'export|download.*data', 'Data export'),
        ),
    },
    pack="government",
)

# --- Fixed values: FED-003 -------------------------------------------------
CIPHER_CONTEXT_WORDS = ("weak", "deprecated", "insecure", "forbidden", "not_allowed")
CIPHER_CONTEXT_CHARS = 50
WEAK_CRYPTO = Rule(
    rule_id="FED-003",
    name="FedRAMP Encryption Standards",
    description="Detects use of weak or deprecated cryptographic algorithms",
    severity="critical",
    category="security",
    languages=_LANGUAGES,
    owasp="A02:2021 - Cryptographic Failures",
    cwe="CWE-327",
    references=(
        "https://www.fedramp.gov/",
        "https://nvd.nist.gov/800-53/Rev4/control/SC-13",
        "https://cwe.mitre.org/data/definitions/327.html",
        "https://csrc.nist.gov/projects/cryptographic-module-validation-program",
    ),
    title="Weak cryptographic algorithm: {label}",
    message="Use of {label} detected. FedRAMP requires FIPS 140-2 "
            "validated cryptographic modules with approved algorithms.",
    flags="",
    check=CIPHER,
    patterns={
        ANY: pats(
            (r'MD5|md5', 'MD5 (deprecated - use SHA-256 or higher)'),
            (r'SHA1|sha1|SHA-1', 'SHA-1 (deprecated - use SHA-256 or higher)'),
            (r'DES(?!3)|des(?!3)', 'DES (deprecated - use AES-256)'),
            (r'RC4|rc4|ARC4|arc4', 'RC4 (broken - use AES)'),
            (r'RC2|rc2', 'RC2 (deprecated - use AES)'),
            (r'Blowfish|blowfish', 'Blowfish (deprecated - use AES-256)'),
            (r'ECB|ecb', 'ECB mode (insecure - use GCM or CBC with HMAC)'),
            (r'PKCS1v15|pkcs1[_\s]?v15', 'PKCS1v1.5 padding (use OAEP)'),
            (r'(?<![A-Za-z])RSA[_\s]?1024(?![0-9])', 'RSA-1024 (use RSA-2048 minimum)'),
            (r'AES[_\s]?128', 'AES-128 (FedRAMP recommends AES-256 for sensitive data)'),
        ),
    },
    pack="government",
)

RULES = (ACCESS_CONTROL, SECURITY_EVENTS, WEAK_CRYPTO)
