"""A code corpus derived from ``orders``: one file per order.

The given tables hold prose, not source code.  Path, language, owner and the
choice of snippets are integer functions of the order row, so any engine that
can evaluate them derives the same bytes, and the corpus grows with ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions.paths import detect_language
from scanfold.sources.tables import spread, table

SNIPPETS: dict[str, list[str]] = {
    "python": [
        'import os\nimport json\n\nLIMIT = 50\n',
        'def fetch_user(user_id):\n    query = f"SELECT * FROM users WHERE id = {user_id}"\n    return db.execute(query)\n',
        'def safe_user(user_id):\n    sql = "SELECT name FROM users WHERE id = ?"\n    return db.execute(sql, (user_id,))\n',
        'def list_dir(path):\n    os.system("ls " + path)\n    os.system(f"du {path}")\n',
        'def run(cmd):\n    subprocess.run(cmd,\n                   shell=True)\n    subprocess.run(["ls", "-la"], check=True)\n',
        'def load(name):\n    with open("/data/" + name) as fh:\n        return pickle.loads(fh.read())\n',
        'def settings(text):\n    return yaml.load(text, Loader=yaml.SafeLoader)\n',
        'def raw_settings(text):\n    return yaml.load(text)\n',
        'def show(patient_name, order):\n    print(f"patient {patient_name}")\n    # print("debug")\n    print("order", order)\n',
        'def store_patient(patient_data):\n    with open("patients.json", "w") as fh:\n        json.dump(patient_data, fh)\n',
        'def get_patient_record(patient_id):\n    return db.find(patient_id)\n',
        'def view_patient_record(patient_id, user):\n    audit_log.info("view", user=user)\n    return db.find(patient_id)\n',
        'def keep_call(call):\n    call_record = CallRecord(call)\n    call_record.save()\n',
        'def keep_call_ttl(call):\n    call_record = CallRecord(call, ttl=365)\n    call_record.save()\n',
        'def get_subscriber(key):\n    subscriber = db.subscriber(key)\n    return subscriber  # phone_number included\n',
        'def hidden_subscriber(key):\n    subscriber = db.subscriber(key)\n    return mask(subscriber)  # phone_number hidden\n',
        '@app.get("/admin/users")\nasync def list_users():\n    return await db.all_users()\n',
        '@app.post("/orders")\n@require_auth\nasync def add_order(body):\n    return await db.add(body)\n',
        'def sign(value):\n    digest = hashlib.md5(value).hexdigest()\n    # sha1 is not used here\n    return DES.new(digest, DES.MODE_ECB)\n',
        'def quiet():\n    try:\n        work()\n    except:\n        pass\n',
        'def noisy():\n    try:\n        work()\n    except ValueError:\n        logger.error("failed")\n        raise\n',
        'API_KEY = "sk_live_realkey123456789"\nTOKEN = os.environ.get("API_TOKEN")\n',
        'password = "changeme-please-now"\nconfig.update(mode="fast")\n',
        'def old_hash(data):\n    # md5 here is weak\n    weak = hashlib.md5(data)\n    strong = hashlib.sha256(data)\n    return weak, strong\n',
        'class ReportBuilder:\n    def build(self):\n        return sum(x for x in range(10))\n',
        'query = "INSERT INTO t VALUES (%s)" % value\nother = "UPDATE t SET a = \'{}\'".format(value)\n',
        'def reset(user):\n    password_hash = update(user)\n    role = assign(user, "admin")\n    return login(user)\n',
    ],
    "javascript": [
        "const fs = require('fs');\nconst limit = 10;\n",
        'function ProcessData(data) {\n    console.log("Processing:", data);\n    return data;\n}\n',
        'function loadUser(id) {\n    const sql = `SELECT * FROM users WHERE id = ${id}`;\n    return db.query(sql);\n}\n',
        'const q = "SELECT * FROM items WHERE id = " + itemId;\n',
        'child_process.exec("ls " + dir, done);\nexecSync(`rm -rf ${dir}`);\n',
        "spawn('ls', [dir], { shell: true });\nspawn('ls', ['-la', dir]);\n",
        'const body = fs.readFileSync("/uploads/" + name);\nres.sendFile("/files/" + req.params.file);\n',
        "const data = eval(JSON.parse(text));\nconst ser = require('node-serialize');\n",
        'try {\n    work();\n} catch (error) {}\n',
        'try {\n    work();\n} catch (e) {\n    // ignore\n}\nfinish();\n',
        'try {\n    work();\n} catch (e) {\n    logger.error("failed", e);\n    throw e;\n}\n',
        'async function fetchAll(ids) {\n    for (const id of ids) {\n        const row = await api.get("/rows/" + id);\n        keep(row);\n    }\n}\n',
        'async function fetchSafe(id) {\n    try {\n        return await api.get("/rows/" + id);\n    } catch (e) {\n        logger.error(e);\n        throw e;\n    }\n}\n',
        'const run = async () => {\n    const Result = await job({ a: 1, b: { c: 2 } });\n    await store(Result, "a name long enough to count");\n};\n',
        'console.log("Patient SSN:", ssn);\n// console.log("quiet");\nconsole.warn("slow"); // console.error("x")\n',
        'localStorage.setItem("patient_record", JSON.stringify(data));\n',
        'sessionStorage.setItem("cart", JSON.stringify(cart));\n',
        'function getPatient(id) {\n    return db.find(id);\n}\n',
        'repo.insertOne(callRecord);\ncache.set("cdr", cdr);\n',
        'res.json({ subscriber, phoneNumber });\n',
        'res.send(redact(subscriber, phoneNumber));\n',
        'app.get("/admin", (req, res) => {\n    res.json(list());\n});\n',
        'router.post("/orders", checkPermission, (req, res) => {\n    res.json(save(req.body));\n});\n',
        "const h = crypto.createHash('sha1').update(data).digest('hex');\n",
        'const password = "correct horse battery";\nconst token = "your-token-here";\n',
        'export function login(user) {\n    return token.create(user);\n}\n',
        'const Limit = 3;\nlet counter = 0;\nconst MAX_SIZE = 9;\n',
    ],
    "typescript": [
        'interface UserData {\n    id: string;\n}\ntype UserId = string;\n',
        'export async function loadRows(id: string): Promise<Row[]> {\n    const rows = await db.query(`SELECT * FROM rows WHERE id = ${id}`);\n    return rows;\n}\n',
        'function BuildReport<T>(rows: T[]) {\n    console.debug(rows.length);\n    return rows;\n}\n',
        'const sql = "DELETE FROM rows WHERE id = " + id;\n',
        'child_process.exec(`tar ${name}`);\neval("f(" + arg + ")");\n',
        'const text = fs.readFile(`/data/${name}`, done);\nconst p = path.join(base, req.query.name);\n',
        'try {\n    await load();\n} catch (error: Error) {}\n',
        'try {\n    await load();\n} catch (_) {\n    again();\n}\n',
        'async load(id: string) {\n    const row = await this.repo.findOne({ where: { id } });\n    this.rows.push(row);\n    return row;\n}\n',
        'async save(row: Row) {\n    await this.repo.save(row).catch(report);\n    this.state = "a state that is long enough";\n}\n',
        '@Get("/admin/users")\nlistUsers() {\n    return this.users.all();\n}\n',
        '@Post("/orders")\n@Roles("admin")\n@Guard(AuthGuard)\naddOrder(body: Order) {\n    return this.orders.add(body);\n}\n',
        'console.log("dob", patient.dob);\nlogger.info("done");\n',
        'localStorage.setItem("diagnosis", value);\n',
        'return { subscriber, msisdn };\n',
        'const digest = createHash("md5").update(x).digest("hex");\nconst iv = "AES_128";\n',
        'const secret = "s3cr3t-value-9";\nconst apiKey = "example-key-123";\n',
        'const ok = createHash("sha256").update(x).digest("hex");\n',
        'logout(): void {\n    this.session.clear();\n    eventLog.write("logout");\n}\n',
        'export const exportHealth = (rows: Row[]) => rows.map(toCsv);\n',
    ],
    "java": [
        'public class UserDao {\n    private static final int MAX_ROWS = 10;\n',
        'public User findUser(String id) {\n    String query = "SELECT * FROM users WHERE id = " + id;\n    return run(query);\n}\n',
        'String q = String.format("SELECT * FROM t WHERE a = %s", a);\n',
        'Runtime.getRuntime().exec("cmd /c " + command);\nnew ProcessBuilder("sh", "-c", command);\n',
        'File file = new File("/uploads/" + name);\nFileInputStream in = new FileInputStream(base + name);\n',
        'ObjectInputStream ois = new ObjectInputStream(stream);\nObject o = ois.readObject();\n',
        'ObjectInputStream ois = new ObjectInputStream(stream);\nois.setObjectInputFilter(filter);\nObject o = ois.readObject();\n',
        'try {\n    work();\n} catch (Exception e) {}\n',
        'try {\n    work();\n} catch (Exception e) {\n    // nothing to do\n}\nfinish();\n',
        'System.out.println("mrn " + mrn);\nlogger.info("saved {}", id);\n',
        'FileOutputStream out = new FileOutputStream(patientFile);\n',
        'repository.save(callLog);\nentityManager.persist(order);\n',
        'return subscriberRepository.load(accountNumber, subscriber);\n',
        '@GetMapping("/admin")\npublic List getUsers() {\n    return users;\n}\n',
        '@PostMapping("/orders")\n@PreAuthorize("hasPermission(0)")\npublic Order createOrder(Order o) {\n    return o;\n}\n',
        'MessageDigest md = MessageDigest.getInstance("MD5");\nCipher c = Cipher.getInstance("AES/ECB/PKCS5Padding");\n',
        'private String password = "hunter2-hunter2";\n',
        'public Record getPatientRecord(String id) {\n    accessLog.write(id);\n    return records.get(id);\n}\n',
    ],
    "go": [
        'package main\n\nimport "fmt"\n',
        'q := fmt.Sprintf("SELECT * FROM users WHERE id = %d", id)\n',
        'rows, err := db.Query("SELECT * FROM t WHERE a = " + a)\n',
        'cmd := exec.Command("sh -c " + input)\n',
        'f, err := os.Open(base + "/" + name)\n',
        'fmt.Println("prescription", rx)\nlog.Printf("ok")\n',
        'store.Insert(cellTower)\nstore.Save(order)\n',
        'fmt.Printf("%v", subscriber.imsi)\n',
        'r.GET("/admin", listUsers)\nr.POST("/orders", requireAuth, addOrder)\n',
        'func GetUser(id int) User {\n    return load(id)\n}\n',
        'sum := md5.Sum(data)\nblock, _ := des.NewCipher(key)\n',
        'sum := sha256.Sum256(data)\n',
        'const token = "9f8e7d6c5b4a3921"\n',
        'if unauthorized {\n    securityLog.Print("denied")\n}\n',
    ],
    "ruby": [
        'require "json"\n\nLIMIT = 5\n',
        'users = User.find_by_sql("SELECT * FROM users WHERE id = #{id}")\n',
        'system("ls #{dir}")\nout = `du #{dir}`\n',
        'text = File.read("/data/#{name}")\n',
        'obj = Marshal.load(data)\ncfg = YAML.load(text)\n',
        'cfg = YAML.safe_load(text)\n',
        'system("ls", "-la", dir)\n',
        'api_key = "live-4f3e2d1c0b9a"\n',
        'def total(rows)\n  rows.sum\nend\n',
    ],
    "php": [
        '<?php\nrequire_once "init.php";\n',
        '$sql = "SELECT * FROM users WHERE id = $id";\n',
        "$sql = 'DELETE FROM t WHERE id = ' . $id;\n",
        'exec("ls " . $dir);\n$out = shell_exec($cmd);\n',
        '$text = file_get_contents($path);\ninclude($template);\n',
        '$obj = unserialize($data);\n',
        '$obj = json_decode($data, true);\n',
        '$password = "let-me-in-please";\n',
        'function total($rows) {\n    return array_sum($rows);\n}\n',
    ],
    "csharp": [
        'using System;\n\nnamespace App {\n',
        'var sql = $"SELECT * FROM Users WHERE Id = {id}";\n',
        'var q = "UPDATE t SET a = " + a;\n',
        'var o = new BinaryFormatter().Deserialize(stream);\n',
        'Console.WriteLine("insurance_id " + id);\n_logger.LogInformation("ok");\n',
        '[HttpGet]\npublic IActionResult GetUsers() {\n    return Ok(users);\n}\n',
        '[HttpPost]\n[Authorize]\npublic IActionResult CreateOrder(Order o) {\n    return Ok(o);\n}\n',
        'using var md5 = MD5.Create();\nusing var sha = SHA256.Create();\n',
        'string secret = "pl4in-t3xt-s3cret";\n',
        'public void DeleteUser(int id) {\n    AuditLogger.Write(id);\n}\n',
    ],
    "other": [
        'fn main() {\n    println!("hi");\n}\n',
        'int add(int a, int b) { return a + b; }\n',
        'build:\n\tmake all\n',
        'let token = "c0ffee-c0ffee-c0ffee";\n',
        'static const char *secret = "test-only-value";\n',
    ],
}

# Copyright and licence headers some files start with; index chosen per file.
HEADERS = [
    "",
    "// MIT License\n// Copyright 2021 Someone\n",
    "# Licensed under the Apache License, Version 2.0\n",
    "/* GNU General Public License, version 3 */\n",
    "// SPDX-License-Identifier: BSD-3-Clause\n",
    "// @author someone\n",
    "// ISC License\n",
    "/* released under the AGPL */\n",
]

# The same text is valid in Spark SQL and in the ANSI-style SQL of the checks.
SNIPPET_LANGUAGE = """
CASE WHEN o_orderkey % 20 < 5 THEN 'python' WHEN o_orderkey % 20 < 8 THEN 'javascript'
     WHEN o_orderkey % 20 < 11 THEN 'typescript' WHEN o_orderkey % 20 < 13 THEN 'java'
     WHEN o_orderkey % 20 = 13 THEN 'go' WHEN o_orderkey % 20 = 14 THEN 'ruby'
     WHEN o_orderkey % 20 = 15 THEN 'php' WHEN o_orderkey % 20 = 16 THEN 'csharp' ELSE 'other' END"""

EXTENSION = """
CASE WHEN o_orderkey % 20 < 5 THEN '.py' WHEN o_orderkey % 20 = 5 THEN '.jsx' WHEN o_orderkey % 20 < 8 THEN '.js'
     WHEN o_orderkey % 20 = 8 THEN '.tsx' WHEN o_orderkey % 20 < 11 THEN '.ts'
     WHEN o_orderkey % 20 < 13 THEN '.java' WHEN o_orderkey % 20 = 13 THEN '.go'
     WHEN o_orderkey % 20 = 14 THEN '.rb' WHEN o_orderkey % 20 = 15 THEN '.php' WHEN o_orderkey % 20 = 16 THEN '.cs'
     WHEN o_orderkey % 20 = 17 THEN '.rs' WHEN o_orderkey % 20 = 18 THEN '.txt' ELSE '' END"""

FOLDER = """
CASE o_orderkey % 13 WHEN 0 THEN 'src/tests/' WHEN 1 THEN 'lib/core/' WHEN 2 THEN 'node_modules/pkg/'
     WHEN 3 THEN 'dist/' WHEN 4 THEN 'src/api/v1/' WHEN 5 THEN 'build/out/' ELSE 'src/' END"""

FILE_STEM = """
CASE o_orderkey % 11 WHEN 0 THEN 'test_mod' WHEN 1 THEN 'app.config.' WHEN 2 THEN 'vendor.min.' ELSE 'mod' END"""

FILE_FIELDS = {
    "file_id": "o_orderkey",
    "org": "'org' || CAST(o_custkey % 25 AS VARCHAR(20))",
    "repo": "'repo' || CAST(o_custkey AS VARCHAR(20))",
    "pr_number": "CAST(o_orderkey % 3 + 1 AS INT)",
    "commit_sha": "md5(CAST(o_custkey AS VARCHAR(20)))",
    "author": "'user' || CAST(o_custkey % 97 AS VARCHAR(20))",
    "file_path": f"({FOLDER}) || ({FILE_STEM}) || CAST(o_orderkey AS VARCHAR(20)) || "
                 f"CASE WHEN o_orderkey % 41 = 0 THEN upper({EXTENSION}) ELSE ({EXTENSION}) END",
}
HEADER_INDEX = "CASE WHEN o_orderkey % 17 < 8 THEN o_orderkey % 17 ELSE 0 END"
SNIPPET_COUNT = "3 + o_orderkey % 6"


def snippet_index(i: str, size: str) -> str:
    """0-based snippet number of slot ``i``."""
    return f"(o_orderkey * (2 * {i} + 3) + {i} * {i} + CAST(floor(o_orderkey / 7.0) AS BIGINT)) % {size}"


def build_files(orders: DataFrame, **carry: str) -> DataFrame:
    """File rows from rows with ``o_orderkey`` and ``o_custkey``; narrow, also on a stream.

    ``carry`` passes further input columns through: new name = old name.
    """
    spark = orders.sparkSession
    bank = F.broadcast(spark.createDataFrame(
        list(SNIPPETS.items()), "snippet_language string, bank array<string>"))
    named = orders.select(
        "*", *[F.expr(sql).alias(name) for name, sql in FILE_FIELDS.items()],
        F.expr(SNIPPET_LANGUAGE).alias("snippet_language"))
    header = F.element_at(F.array(*[F.lit(h) for h in HEADERS]), (F.expr(HEADER_INDEX) + 1).cast("int"))
    body = F.expr(f"""array_join(transform(sequence(0, CAST({SNIPPET_COUNT} AS INT) - 1),
        i -> element_at(bank, CAST({snippet_index('i', 'size(bank)')} AS INT) + 1)), '\n')""")
    return named.join(bank, "snippet_language").select(
        *FILE_FIELDS, *[F.col(old).alias(new) for new, old in carry.items()], detect_language(F.col("file_path")).alias("language"),
        F.concat(header, body).alias("code"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return build_files(spread(orders, "o_orderkey"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real texts as files: ``documents`` with their source as repository."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return spread(docs, "doc_id").select(
        F.col("doc_id").alias("file_id"), F.lit("docs").alias("org"), F.col("source").alias("repo"),
        F.lit(1).alias("pr_number"), F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt")).alias("file_path"),
        F.lit("txt").alias("language"), F.col("text").alias("code"))
