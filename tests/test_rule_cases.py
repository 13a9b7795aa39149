"""Single-rule cases: each text must give at least one hit of its rule, or none."""

import pytest

from scanfold.catalog import Catalogue
from test_scan_model import FILE_SCHEMA
from scanfold.operators.scan import explode_violations, find_violations

HIT, NONE = True, False
CASES = [
    ("SEC-001", "python", "test.py", 'API_KEY = "sk_live_realkey123456789"', HIT),
    ("SEC-001", "typescript", "src/config.ts", 'const API_KEY = "sk_live_test123456789";', NONE),
    ("SEC-001", "python", "a.py", 'api_key = os.environ.get("API_KEY")', NONE),
    ("SEC-001", "rust", "a.rs", 'let token = "c0ffee-c0ffee";', HIT),
    ("SEC-002", "python", "db.py", 'query = f"SELECT * FROM users WHERE id = {user_id}"', HIT),
    ("SEC-002", "python", "db.py", 'query = "SELECT * FROM users WHERE name = {}".format(user_name)', HIT),
    ("SEC-002", "python", "db.py", 'query = "SELECT * FROM users WHERE id = %s" % user_id', HIT),
    ("SEC-002", "javascript", "db.js", "const query = `SELECT * FROM users WHERE id = ${userId}`;", HIT),
    ("SEC-002", "javascript", "db.js", 'const query = "SELECT * FROM users WHERE id = " + userId;', HIT),
    ("SEC-002", "typescript", "db.ts", "const q = `SELECT * FROM orders WHERE customer_id = ${customerId}`;", HIT),
    ("SEC-002", "java", "UserDao.java", 'String query = "SELECT * FROM users WHERE id = " + userId;', HIT),
    ("SEC-002", "python", "db.py", 'q = "SELECT * FROM users WHERE id = %s"\nreturn cursor.execute(q, (user_id,))', NONE),
    ("SEC-002", "javascript", "db.js", "const r = await db.query('SELECT * FROM users WHERE id = $1', [userId]);", NONE),
    ("SEC-002", "javascript", "p.js", "q = \"SELECT * FROM products WHERE category = '\" + userInput + \"'\"", HIT),
    ("SEC-003", "python", "cmd.py", 'os.system(f"ls {user_input}")', HIT),
    ("SEC-003", "python", "cmd.py", 'subprocess.run(f"echo {user_input}", shell=True)', HIT),
    ("SEC-003", "python", "cmd.py", "subprocess.call(cmd, shell=True)", HIT),
    ("SEC-003", "python", "cmd.py", "proc = subprocess.Popen(command, shell=True)", HIT),
    ("SEC-003", "python", "cmd.py", 'result = eval("print(" + user_input + ")")', HIT),
    ("SEC-003", "javascript", "cmd.js", 'child_process.exec("ls " + userInput, callback);', HIT),
    ("SEC-003", "javascript", "cmd.js", "execSync(`rm -rf ${userInput}`);", HIT),
    ("SEC-003", "javascript", "cmd.js", "spawn('ls', [userInput], { shell: true });", HIT),
    ("SEC-003", "java", "Cmd.java", 'Runtime.getRuntime().exec("cmd /c " + userCommand);', HIT),
    ("SEC-003", "java", "Cmd.java", 'ProcessBuilder pb = new ProcessBuilder("sh -c " + command);', HIT),
    ("SEC-003", "php", "cmd.php", 'exec("ls " . $userInput);', HIT),
    ("SEC-003", "php", "cmd.php", "$output = shell_exec($command);", HIT),
    ("SEC-003", "ruby", "cmd.rb", 'system("ls #{user_input}")', HIT),
    ("SEC-003", "ruby", "cmd.rb", "result = `ls #{directory}`", HIT),
    ("SEC-003", "go", "cmd.go", 'cmd := exec.Command("sh -c " + userInput)', HIT),
    ("SEC-003", "python", "cmd.py", "subprocess.run(['ls', '-la', directory], check=True)", NONE),
    ("SEC-003", "javascript", "cmd.js", "const child = spawn('ls', ['-la', directory]);", NONE),
    ("SEC-004", "python", "files.py", 'with open(f"/data/{filename}") as f:\n    return f.read()', HIT),
    ("SEC-004", "python", "files.py", 'data = open("/uploads/{}".format(filename)).read()', HIT),
    ("SEC-004", "python", "files.py", "shutil.copy(source + user_file, destination)", HIT),
    ("SEC-004", "javascript", "files.js", 'const data = fs.readFileSync("/uploads/" + filename);', HIT),
    ("SEC-004", "javascript", "files.js", "const c = fs.readFile(`/data/${userInput}`, callback);", HIT),
    ("SEC-004", "javascript", "files.js", 'res.sendFile("/uploads/" + req.params.file);', HIT),
    ("SEC-004", "javascript", "files.js", 'const module = require("./" + moduleName);', HIT),
    ("SEC-004", "java", "Files.java", 'File file = new File("/uploads/" + userFilename);', HIT),
    ("SEC-004", "java", "Files.java", 'Path path = Paths.get(baseDir + "/" + userInput);', HIT),
    ("SEC-004", "php", "files.php", "$content = file_get_contents($userPath);", HIT),
    ("SEC-004", "php", "files.php", "include($template);", HIT),
    ("SEC-004", "ruby", "files.rb", 'content = File.read("/data/#{filename}")', HIT),
    ("SEC-004", "go", "files.go", 'file, err := os.Open(baseDir + "/" + filename)', HIT),
    ("SEC-004", "python", "files.py", 'with open("/etc/config.json") as f:\n    config = json.load(f)', NONE),
    ("SEC-005", "python", "app.py", "return pickle.loads(data)", HIT),
    ("SEC-005", "python", "config.py", "return yaml.load(config_str)", HIT),
    ("SEC-005", "python", "config.py", "return yaml.safe_load(config_str)", NONE),
    ("SEC-005", "python", "config.py", "return yaml.load(config_str, Loader=yaml.SafeLoader)", NONE),
    ("SEC-005", "javascript", "app.js", "return eval(JSON.parse(input));", HIT),
    ("SEC-005", "javascript", "app.js", "const serialize = require('node-serialize');", HIT),
    ("SEC-005", "java", "L.java", "ObjectInputStream ois = new ObjectInputStream(stream);", HIT),
    ("SEC-005", "php", "a.php", "$obj = unserialize($data);", HIT),
    ("SEC-005", "ruby", "a.rb", "obj = Marshal.load(data)", HIT),
    ("SEC-005", "csharp", "a.cs", "var o = new BinaryFormatter().Deserialize(stream);", HIT),
    ("STD-001", "python", "utils.py", "def get_user_by_id(user_id):\n    return users.get(user_id)", NONE),
    ("STD-001", "python", "services.py", "class HTTPClient:\n    pass", NONE),
    ("STD-001", "javascript", "utils.js", "const calculateTotal = () => {};", NONE),
    ("STD-001", "javascript", "utils.js", "function ProcessData(data) {}", HIT),
    ("STD-001", "javascript", "utils.js", "const MAX = 3;", HIT),
    ("STD-001", "rust", "main.rs", "fn GetUser(id: i32) -> User {}", NONE),
    ("STD-002", "javascript", "service.js", 'console.log("Processing data:", data);', HIT),
    ("STD-002", "python", "service.py", 'print("Processing data:", data)', HIT),
    ("STD-002", "javascript", "user.test.js", 'console.log("Test output");', NONE),
    ("STD-002", "python", "test_service.py", 'print("Test output")', NONE),
    ("STD-002", "javascript", "webpack.config.js", 'console.log("Starting");', NONE),
    ("STD-002", "javascript", "service.js", '    // console.log("Debug message");', NONE),
    ("STD-002", "python", "service.py", '    # print("Debug message")', NONE),
    ("STD-002", "python", "service.py", 'logger.info("Processing data")', NONE),
    ("STD-003", "javascript", "service.js", "try {\n    risky();\n} catch (error) {}", HIT),
    ("STD-003", "javascript", "service.js", "try {\n    risky();\n} catch (error) {\n    // ignore\n}", HIT),
    ("STD-003", "javascript", "service.js", "try {\n    risky();\n} catch (_) {\n    other();\n}", HIT),
    ("STD-003", "python", "service.py", "try:\n    risky()\nexcept:\n    pass", HIT),
    ("STD-003", "python", "service.py", "try:\n    risky()\nexcept Exception:\n    pass", HIT),
    ("STD-003", "java", "Service.java", "try {\n    risky();\n} catch (Exception e) {}", HIT),
    ("STD-003", "javascript", "service.js", "try {\n risky();\n} catch (error) {\n    throw new E(error);\n}", NONE),
    ("STD-003", "javascript", "service.js",
     "async function load() {\n    const rows = await api.get('/a/long/enough/path');\n    keep(rows);\n}", HIT),
    ("HIPAA-001", "python", "processor.py", 'print(f"Processing patient: {patient_name}")', HIT),
    ("HIPAA-001", "javascript", "processor.js", 'console.log("Patient SSN:", ssn);', HIT),
    ("HIPAA-001", "python", "orders.py", 'print(f"Processing order: {order_id}")', NONE),
    ("HIPAA-002", "python", "s.py", 'with open("patients.json", "w") as f:\n    json.dump(patient_data, f)', HIT),
    ("HIPAA-002", "javascript", "s.js", 'localStorage.setItem("patient_record", JSON.stringify(data));', HIT),
    ("HIPAA-003", "python", "records.py", "def get_patient_record(patient_id):\n    return 1", HIT),
    ("HIPAA-003", "python", "records.py", 'def get_patient_record(i):\n    audit_log.info("PHI access")', NONE),
    ("TEL-001", "python", "cdr.py", "call_record = CallRecord(**d)\ncall_record.save()", HIT),
    ("TEL-001", "python", "cdr.py", "call_record = CallRecord(**d)\ncall_record.ttl = 3\ncall_record.save()", NONE),
    ("TEL-002", "python", "api.py", "return subscriber  # Returns full phone_number", HIT),
    ("TEL-002", "python", "api.py", "return mask(subscriber)  # phone_number", NONE),
    ("FED-001", "python", "api.py", '@app.get("/admin/users")\nasync def list_users():\n    return 1', HIT),
    ("FED-001", "python", "api.py", '@app.get("/admin/users")\n@require_auth\nasync def list_users():\n    return 1', NONE),
    ("FED-002", "python", "auth.py", "async def login(credentials):\n    user = await authenticate(credentials)", HIT),
    ("FED-002", "python", "auth.py", 'async def login(c):\n    audit_log.info("login_success")', NONE),
    ("FED-003", "python", "auth.py", "return hashlib.md5(password.encode()).hexdigest()", HIT),
    ("FED-003", "javascript", "crypto.js", "const h = crypto.createHash('sha1').update(data);", HIT),
    ("FED-003", "python", "crypto.py", "cipher = DES.new(key, DES.MODE_ECB)", HIT),
    ("FED-003", "python", "hash.py", "return hashlib.sha256(data.encode()).hexdigest()", NONE),
    ("FED-003", "python", "crypto.py", "cipher = Cipher(algorithms.AES256(key), GCM(iv))", NONE),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, "o", "r", path, language, "\n" + code + "\n") for i, (_, language, path, code, _) in enumerate(CASES)]
    files = spark.createDataFrame(rows, FILE_SCHEMA).repartition(8, "file_id")
    catalogue = Catalogue.builtin()
    hits = explode_violations(find_violations(files, catalogue.list_rules(), languages=catalogue.languages()))
    return {(r["file_id"], r["rule_id"]) for r in hits.select("file_id", "rule_id").collect()}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_case(found, number):
    rule_id, _, _, code, expect = CASES[number]
    assert ((number, rule_id) in found) == expect, code
