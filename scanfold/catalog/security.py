"""Default security pack."""

from __future__ import annotations

from scanfold.catalog.model import ANY, CAPTURE, WINDOW, Rule, pats

# --- Fixed values: SEC-001 -------------------------------------------------
SECRETS = Rule(
    rule_id="SEC-001",
    name="Hardcoded Secrets Detection",
    description="Detects credentials written as string literals",
    severity="critical",
    category="security",
    languages=(),
    owasp="A07:2021 - Identification and Authentication Failures",
    cwe="CWE-798",
    references=("https://cwe.mitre.org/data/definitions/798.html",),
    title="Hardcoded Secret Detected",
    message="A {label} is assigned a literal value. Anyone who can read the source can use the credential.",
    flags="i",
    check=CAPTURE,
    patterns={
        ANY: pats(
            (r'(?:api[_-]?key|secret|password|passwd|pwd|token)\w*\s*[:=]\s*["\']([^"\']{8,})["\']',
             "credential-like name", None, None, None, r"(?:test|example|changeme|placeholder|your)"),
        ),
    },
    pack="default-security",
)

# --- Fixed values: SEC-002 -------------------------------------------------
SQL_INJECTION = Rule(
    rule_id="SEC-002",
    name="SQL Injection Detection",
    description="Detects potential SQL injection vulnerabilities from string concatenation or formatting",
    severity="critical",
    category="security",
    languages=("python", "javascript", "typescript", "java", "php", "ruby", "go", "csharp"),
    owasp="A03:2021 - Injection",
    cwe="CWE-89",
    references=(
        "https://cwe.mitre.org/data/definitions/89.html",
        "https://owasp.org/Top10/A03_2021-Injection/",
        "https://cheatsheetseries.owasp.org/cheatsheets/SQL_Injection_Prevention_Cheat_Sheet.html",
    ),
    title="Potential SQL Injection Vulnerability",
    message="SQL query built using {label}. User input may be directly concatenated into the SQL query, "
            "allowing attackers to manipulate the query.",
    flags="im",
    multi_line=True,
    snippet_span=True,
    patterns={
        "python": pats(
            (r'f["\'][^"\']*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"\']*\{[^}]+\}', 'f-string SQL'),
            (r'["\'][^"\']*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"\']*["\']\.format\s*\(', '.format() SQL'),
            (r'["\'][^"\']*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"\']*%s[^"\']*["\'].*%', '% formatting SQL'),
            (r'(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"\']*["\']\s*\+\s*\w+', 'concatenation SQL'),
        ),
        "javascript": pats(
            (r'`[^`]*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^`]*\$\{[^}]+\}', 'template literal SQL'),
            (r'["\'][^"\']*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"\']*["\']\s*\+\s*\w+', 'concatenation SQL'),
            (r'\+\s*["\'][^"\']*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)', 'concatenation SQL'),
        ),
        "typescript": pats(
            (r'`[^`]*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^`]*\$\{[^}]+\}', 'template literal SQL'),
            (r'["\'][^"\']*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"\']*["\']\s*\+\s*\w+', 'concatenation SQL'),
        ),
        "java": pats(
            (r'["\'][^"\']*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"\']*["\']\s*\+\s*\w+', 'concatenation SQL'),
            (r'String\.format\s*\([^)]*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)', 'String.format SQL'),
        ),
        "php": pats(
            (r'"[^"]*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"]*\$\w+', 'variable interpolation SQL'),
            (r'["\'][^"\']*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"\']*["\']\s*\.\s*\$', 'concatenation SQL'),
        ),
        "ruby": pats(
            (r'"[^"]*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"]*#\{[^}]+\}', 'interpolation SQL'),
        ),
        "go": pats(
            (r'fmt\.Sprintf\s*\([^)]*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)', 'fmt.Sprintf SQL'),
            (r'["`][^"`]*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"`]*["`]\s*\+\s*\w+', 'concatenation SQL'),
        ),
        "csharp": pats(
            (r'\$"[^"]*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"]*\{[^}]+\}', 'interpolation SQL'),
            (r'["\'][^"\']*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^"\']*["\']\s*\+\s*\w+', 'concatenation SQL'),
        ),
        ANY: pats(
            (r'(?:SELECT|INSERT|UPDATE|DELETE)\s+.*\s+(?:FROM|INTO|SET)\s+.*\s*\+\s*\w+', 'concatenation'),
            (r'WHERE\s+\w+\s*=\s*["\']?\s*\+\s*\w+', 'WHERE concatenation'),
        ),
    },
    pack="default-security",
)

# --- Fixed values: SEC-003 -------------------------------------------------
COMMAND_INJECTION = Rule(
    rule_id="SEC-003",
    name="Command Injection Detection",
    description="Detects potential command injection vulnerabilities from unsafe shell command execution",
    severity="critical",
    category="security",
    languages=("python", "javascript", "typescript", "java", "php", "ruby", "go"),
    owasp="A03:2021 - Injection",
    cwe="CWE-78",
    references=(
        "https://cwe.mitre.org/data/definitions/78.html",
        "https://owasp.org/Top10/A03_2021-Injection/",
        "https://cheatsheetseries.owasp.org/cheatsheets/OS_Command_Injection_Defense_Cheat_Sheet.html",
    ),
    title="Potential Command Injection Vulnerability",
    message="Unsafe use of {label}. User input may be directly included in a shell command, "
            "allowing attackers to execute arbitrary commands on the system.",
    flags="im",
    multi_line=True,
    snippet_span=True,
    patterns={
        "python": pats(
            (r'os\.system\s*\([^)]*\+', 'os.system with concatenation'),
            (r'os\.system\s*\(f["\']', 'os.system with f-string'),
            (r'os\.system\s*\([^)]*\.format\s*\(', 'os.system with .format()'),
            (r'os\.popen\s*\([^)]*\+', 'os.popen with concatenation'),
            (r'subprocess\.call\s*\([^)]*shell\s*=\s*True', 'subprocess with shell=True'),
            (r'subprocess\.run\s*\([^)]*shell\s*=\s*True', 'subprocess.run with shell=True'),
            (r'subprocess\.Popen\s*\([^)]*shell\s*=\s*True', 'subprocess.Popen with shell=True'),
            (r'eval\s*\([^)]*\+', 'eval with concatenation'),
            (r'exec\s*\([^)]*\+', 'exec with concatenation'),
        ),
        "javascript": pats(
            (r'child_process\.exec\s*\([^)]*\+', 'exec with concatenation'),
            (r'child_process\.exec\s*\(`', 'exec with template literal'),
            (r'require\s*\(["\']child_process["\']\)\.exec\s*\(', 'child_process.exec'),
            (r'execSync\s*\([^)]*\+', 'execSync with concatenation'),
            (r'execSync\s*\(`', 'execSync with template literal'),
            (r'spawn\s*\([^)]*\{[^}]*shell\s*:\s*true', 'spawn with shell: true'),
            (r'eval\s*\([^)]*\+', 'eval with concatenation'),
        ),
        "typescript": pats(
            (r'child_process\.exec\s*\([^)]*\+', 'exec with concatenation'),
            (r'child_process\.exec\s*\(`', 'exec with template literal'),
            (r'execSync\s*\([^)]*\+', 'execSync with concatenation'),
            (r'spawn\s*\([^)]*\{[^}]*shell\s*:\s*true', 'spawn with shell: true'),
            (r'eval\s*\([^)]*\+', 'eval with concatenation'),
        ),
        "java": pats(
            (r'Runtime\.getRuntime\(\)\.exec\s*\([^)]*\+', 'Runtime.exec with concatenation'),
            (r'ProcessBuilder\s*\([^)]*\+', 'ProcessBuilder with concatenation'),
        ),
        "php": pats(
            (r'exec\s*\([^)]*\$', 'exec with variable'),
            (r'shell_exec\s*\([^)]*\$', 'shell_exec with variable'),
            (r'system\s*\([^)]*\$', 'system with variable'),
            (r'passthru\s*\([^)]*\$', 'passthru with variable'),
            (r'popen\s*\([^)]*\$', 'popen with variable'),
            (r'proc_open\s*\([^)]*\$', 'proc_open with variable'),
            (r'`[^`]*\$', 'backtick execution with variable'),
        ),
        "ruby": pats(
            (r'system\s*\([^)]*#\{', 'system with interpolation'),
            (r'exec\s*\([^)]*#\{', 'exec with interpolation'),
            (r'`[^`]*#\{', 'backtick execution with interpolation'),
            (r'%x\{[^}]*#\{', '%x with interpolation'),
            (r'IO\.popen\s*\([^)]*#\{', 'IO.popen with interpolation'),
        ),
        "go": pats(
            (r'exec\.Command\s*\([^)]*\+', 'exec.Command with concatenation'),
            (r'exec\.CommandContext\s*\([^)]*\+', 'exec.CommandContext with concatenation'),
        ),
    },
    pack="default-security",
)

# --- Fixed values: SEC-004 -------------------------------------------------
PATH_TRAVERSAL = Rule(
    rule_id="SEC-004",
    name="Path Traversal Detection",
    description="Detects potential path traversal vulnerabilities from unsafe file path handling",
    severity="high",
    category="security",
    languages=("python", "javascript", "typescript", "java", "php", "ruby", "go"),
    owasp="A01:2021 - Broken Access Control",
    cwe="CWE-22",
    references=(
        "https://cwe.mitre.org/data/definitions/22.html",
        "https://owasp.org/Top10/A01_2021-Broken_Access_Control/",
        "https://cheatsheetseries.owasp.org/cheatsheets/Input_Validation_Cheat_Sheet.html",
    ),
    title="Potential Path Traversal Vulnerability",
    message="Unsafe use of {label}. User input may be used to construct file paths, "
            "allowing attackers to access files outside the intended directory.",
    flags="im",
    multi_line=True,
    snippet_span=True,
    patterns={
        "python": pats(
            (r'open\s*\([^)]*\+', 'open() with concatenation'),
            (r'open\s*\(f["\']', 'open() with f-string'),
            (r'open\s*\([^)]*\.format\s*\(', 'open() with .format()'),
            (r'os\.path\.join\s*\([^)]*request\.\w+', 'os.path.join with request data'),
            (r'Path\s*\([^)]*\+', 'Path() with concatenation'),
            (r'shutil\.copy\s*\([^)]*\+', 'shutil.copy with concatenation'),
            (r'send_file\s*\([^)]*\+', 'send_file with concatenation'),
        ),
        "javascript": pats(
            (r'fs\.readFile(?:Sync)?\s*\([^)]*\+', 'fs.readFile with concatenation'),
            (r'fs\.readFile(?:Sync)?\s*\(`', 'fs.readFile with template literal'),
            (r'fs\.writeFile(?:Sync)?\s*\([^)]*\+', 'fs.writeFile with concatenation'),
            (r'path\.join\s*\([^)]*req\.\w+', 'path.join with request data'),
            (r'res\.sendFile\s*\([^)]*\+', 'res.sendFile with concatenation'),
            (r'require\s*\([^)]*\+', 'require with concatenation'),
        ),
        "typescript": pats(
            (r'fs\.readFile(?:Sync)?\s*\([^)]*\+', 'fs.readFile with concatenation'),
            (r'fs\.readFile(?:Sync)?\s*\(`', 'fs.readFile with template literal'),
            (r'path\.join\s*\([^)]*req\.\w+', 'path.join with request data'),
            (r'res\.sendFile\s*\([^)]*\+', 'res.sendFile with concatenation'),
        ),
        "java": pats(
            (r'new\s+File\s*\([^)]*\+', 'new File() with concatenation'),
            (r'new\s+FileInputStream\s*\([^)]*\+', 'FileInputStream with concatenation'),
            (r'Files\.read\w+\s*\([^)]*\+', 'Files.read* with concatenation'),
            (r'Paths\.get\s*\([^)]*\+', 'Paths.get with concatenation'),
        ),
        "php": pats(
            (r'file_get_contents\s*\([^)]*\$', 'file_get_contents with variable'),
            (r'fopen\s*\([^)]*\$', 'fopen with variable'),
            (r'include\s*\([^)]*\$', 'include with variable'),
            (r'require\s*\([^)]*\$', 'require with variable'),
            (r'readfile\s*\([^)]*\$', 'readfile with variable'),
        ),
        "ruby": pats(
            (r'File\.read\s*\([^)]*#\{', 'File.read with interpolation'),
            (r'File\.open\s*\([^)]*#\{', 'File.open with interpolation'),
            (r'send_file\s*\([^)]*#\{', 'send_file with interpolation'),
            (r'IO\.read\s*\([^)]*#\{', 'IO.read with interpolation'),
        ),
        "go": pats(
            (r'os\.Open\s*\([^)]*\+', 'os.Open with concatenation'),
            (r'ioutil\.ReadFile\s*\([^)]*\+', 'ioutil.ReadFile with concatenation'),
            (r'filepath\.Join\s*\([^)]*r\.\w+', 'filepath.Join with request data'),
            (r'http\.ServeFile\s*\([^)]*\+', 'http.ServeFile with concatenation'),
        ),
    },
    pack="default-security",
)

# --- Fixed values: SEC-005 -------------------------------------------------
DESERIALIZATION = Rule(
    rule_id="SEC-005",
    name="Insecure Deserialization Detection",
    description="Detects potentially unsafe deserialization of untrusted data",
    severity="critical",
    category="security",
    languages=("python", "javascript", "typescript", "java", "php", "ruby", "csharp"),
    owasp="A08:2021 - Software and Data Integrity Failures",
    cwe="CWE-502",
    references=(
        "https://cwe.mitre.org/data/definitions/502.html",
        "https://owasp.org/Top10/A08_2021-Software_and_Data_Integrity_Failures/",
        "https://cheatsheetseries.owasp.org/cheatsheets/Deserialization_Cheat_Sheet.html",
    ),
    title="Insecure Deserialization Vulnerability",
    message="Detected {label}. Deserializing untrusted data can lead to "
            "remote code execution, denial of service, or other attacks.",
    flags="im",
    check=WINDOW,
    before=2,
    after=3,
    multi_line=True,
    suppress={
        "python": (r'yaml\.safe_load', r'yaml\.SafeLoader', r'Loader\s*=\s*yaml\.SafeLoader'),
        "java": (r'ObjectInputFilter', r'setObjectInputFilter', r'lookAheadObjectInputStream'),
    },
    patterns={
        "python": pats(
            (r'pickle\.loads?\s*\(', 'pickle.load/loads - can execute arbitrary code'),
            (r'cPickle\.loads?\s*\(', 'cPickle.load/loads - can execute arbitrary code'),
            (r'_pickle\.loads?\s*\(', '_pickle.load/loads - can execute arbitrary code'),
            (r'shelve\.open\s*\(', 'shelve.open - uses pickle internally'),
            (r'marshal\.loads?\s*\(', 'marshal.load/loads - unsafe for untrusted data'),
            (r'yaml\.load\s*\([^)]*\)', 'yaml.load without safe_load - can execute code'),
            (r'yaml\.unsafe_load\s*\(', 'yaml.unsafe_load - explicitly unsafe'),
            (r'jsonpickle\.decode\s*\(', 'jsonpickle.decode - can execute arbitrary code'),
            (r'dill\.loads?\s*\(', 'dill.load/loads - can execute arbitrary code'),
            (r'cloudpickle\.loads?\s*\(', 'cloudpickle - can execute arbitrary code'),
        ),
        "javascript": pats(
            (r'eval\s*\(\s*JSON\.parse', 'eval with JSON.parse - code execution risk'),
            (r'new\s+Function\s*\([^)]*JSON', 'Function constructor with JSON - code execution'),
            (r'serialize-javascript.*\{\s*unsafe', 'serialize-javascript with unsafe option'),
            (r'node-serialize', 'node-serialize - known RCE vulnerability'),
            (r'funcster', 'funcster - deserializes functions'),
        ),
        "typescript": pats(
            (r'eval\s*\(\s*JSON\.parse', 'eval with JSON.parse - code execution risk'),
            (r'new\s+Function\s*\([^)]*JSON', 'Function constructor with JSON - code execution'),
            (r'node-serialize', 'node-serialize - known RCE vulnerability'),
        ),
        "java": pats(
            (r'ObjectInputStream\s*\(', 'ObjectInputStream - Java deserialization vulnerability'),
            (r'XMLDecoder\s*\(', 'XMLDecoder - can execute arbitrary code'),
            (r'XStream\s*\(\s*\)\.fromXML', 'XStream.fromXML - deserialization risk'),
            (r'readObject\s*\(\s*\)', 'readObject() - potential gadget chain'),
            (r'ObjectMapper.*enableDefaultTyping', 'Jackson enableDefaultTyping - polymorphic deserialization'),
            (r'@JsonTypeInfo.*Id\.CLASS', 'Jackson JsonTypeInfo with CLASS - deserialization risk'),
            (r'SerializationUtils\.deserialize', 'Apache Commons SerializationUtils - unsafe'),
            (r'Yaml\s*\(\s*\)\.load', 'SnakeYAML load - can instantiate arbitrary classes'),
        ),
        "php": pats(
            (r'unserialize\s*\(', 'unserialize() - PHP object injection vulnerability'),
            (r'maybe_unserialize\s*\(', 'maybe_unserialize() - WordPress deserialization'),
        ),
        "ruby": pats(
            (r'Marshal\.load\s*\(', 'Marshal.load - can execute arbitrary code'),
            (r'YAML\.load\s*\(', 'YAML.load - can instantiate arbitrary objects'),
            (r'Psych\.load\s*\(', 'Psych.load - unsafe YAML loading'),
            (r'Oj\.load\s*\([^)]*mode:\s*:object', 'Oj.load with object mode - unsafe'),
        ),
        "csharp": pats(
            (r'BinaryFormatter\s*\(\s*\)\.Deserialize', 'BinaryFormatter.Deserialize - unsafe'),
            (r'NetDataContractSerializer.*Deserialize', 'NetDataContractSerializer - unsafe'),
            (r'ObjectStateFormatter.*Deserialize', 'ObjectStateFormatter - unsafe'),
            (r'SoapFormatter.*Deserialize', 'SoapFormatter - unsafe'),
            (r'LosFormatter.*Deserialize', 'LosFormatter - unsafe'),
            (r'JsonConvert\.DeserializeObject.*TypeNameHandling', 'Json.NET TypeNameHandling - risk'),
            (r'JavaScriptSerializer\s*\(\s*\)\.Deserialize', 'JavaScriptSerializer - type confusion'),
        ),
    },
    pack="default-security",
)

RULES = (SECRETS, SQL_INJECTION, COMMAND_INJECTION, PATH_TRAVERSAL, DESERIALIZATION)
