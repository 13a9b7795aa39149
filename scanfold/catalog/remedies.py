"""Suggested fixes, one short text per rule (and language where it matters).

Joined late, only to rows that are shown to a person.
"""

from __future__ import annotations

DEFAULT = "*"

REMEDIES: dict[str, dict[str, str]] = {
    "SEC-001": {DEFAULT: "Read the credential from the environment or a secret store and rotate the exposed value."},
    "SEC-002": {
        "python": "Pass values as query parameters: cursor.execute(sql, (value,)).",
        "javascript": "Pass values as query parameters: db.query(sql, [value]).",
        "typescript": "Pass values as query parameters: db.query(sql, [value]).",
        "java": "Bind values with PreparedStatement placeholders.",
        "php": "Prepare the statement with PDO and bind the values.",
        "ruby": "Use ActiveRecord placeholders: where('id = ?', id).",
        "go": "Pass values as arguments of db.Query instead of formatting them in.",
        "csharp": "Add the values through SqlCommand.Parameters.",
        DEFAULT: "Use parameterized queries or prepared statements.",
    },
    "SEC-003": {
        "python": "Call subprocess.run with a list of arguments and without shell=True.",
        "javascript": "Use execFile or spawn with an argument array and no shell.",
        "typescript": "Use execFile or spawn with an argument array and no shell.",
        "java": "Give ProcessBuilder the program and each argument separately.",
        "php": "Avoid the shell; where it is unavoidable, quote with escapeshellarg().",
        "ruby": "Use the multi-argument form of system or Open3.capture3.",
        "go": "Pass each argument of exec.Command separately.",
        DEFAULT: "Never build shell command lines from user input.",
    },
    "SEC-004": {
        DEFAULT: "Validate the name, keep only its basename, resolve the full path and check that it stays "
                 "inside the base directory.",
    },
    "SEC-005": {
        "python": "Use json.loads, or yaml.safe_load for YAML; unpickle only data whose signature was checked.",
        "javascript": "Use JSON.parse and validate against a schema; never evaluate serialized input.",
        "typescript": "Use JSON.parse and validate against a schema; never evaluate serialized input.",
        "java": "Prefer JSON with fixed types; otherwise install an ObjectInputFilter allow-list.",
        "php": "Use json_decode, or unserialize with allowed_classes set to false.",
        "ruby": "Use JSON.parse or YAML.safe_load.",
        "csharp": "Use System.Text.Json with fixed types.",
        DEFAULT: "Use a data-only format and validate it before use.",
    },
    "STD-002": {
        "python": "Use logging.getLogger(__name__) and logger.info instead of print.",
        DEFAULT: "Use a structured logger such as pino: logger.info({ event }, 'message').",
    },
    "STD-003": {
        "python": "Catch the specific exception, log it with exc_info and raise again or return a default.",
        DEFAULT: "Log the error with context, then throw it again or handle it explicitly.",
    },
    "HIPAA-001": {DEFAULT: "Log a hashed identifier instead of the health field."},
    "HIPAA-002": {DEFAULT: "Encrypt the record before it is stored; keep the key outside the store."},
    "HIPAA-003": {DEFAULT: "Write an audit log entry (who, which record, purpose) next to the access."},
    "TEL-001": {DEFAULT: "Store the record with a retention date and purge it when the period ends."},
    "TEL-002": {DEFAULT: "Mask or drop subscriber fields and check authorization before returning them."},
    "FED-001": {DEFAULT: "Require authentication and a permission check on the endpoint."},
    "FED-002": {DEFAULT: "Emit an audit log entry with actor, action, target and outcome."},
    "FED-003": {DEFAULT: "Use AES-256-GCM, SHA-256 or stronger, RSA-2048 or stronger, or ECDSA P-256."},
}

