"""Patterns, word lists and constants that results depend on. They are stated as they must be.

Patterns are Java's. A word character is ``[\\p{L}\\p{N}_]`` whatever the engine's default.
"""

W = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD, NOT_BEFORE_WORD = rf"(?<!{W})", rf"(?!{W})"

# Separators that normalise to one ASCII character each.
DASHES = "‐‑‒–—―−⁃﹘﹣－"
SPACES = "            　"

EMAIL = rf"{NOT_AFTER_WORD}(?={W})[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{N}}_-]+)*\.[A-Za-z]{{2,}}{NOT_BEFORE_WORD}"
IPV4 = rf"{NOT_AFTER_WORD}(?:\d{{1,3}}\.){{3}}\d{{1,3}}{NOT_BEFORE_WORD}"
_H = "[0-9A-Fa-f]{1,4}"
IPV6 = (
    r"(?<![\p{L}\p{N}_:.])(?:"
    rf"(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}"
    rf"|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}|{_H}:(?::{_H}){{1,6}}|:(?:(?::{_H}){{1,7}}|:)"
    r")(?![\p{L}\p{N}_:.])"
)
POSTAL = rf"{NOT_AFTER_WORD}[A-Za-z]\d[A-Za-z]\s?\d[A-Za-z]\d{NOT_BEFORE_WORD}"
UUID = rf"{NOT_AFTER_WORD}[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}{NOT_BEFORE_WORD}"
IBAN = rf"(?i){NOT_AFTER_WORD}[A-Z]{{2}}\d{{2}}(?:[A-Z0-9]{{11,30}}|(?:[ -][A-Z0-9]{{2,4}}){{3,8}}){NOT_BEFORE_WORD}"
PHONE = rf"{NOT_AFTER_WORD}(?:\+?1[ .\-]?)?\(?\d{{3}}\)?[ .\-]?\d{{3}}[ .\-]?\d{{4}}{NOT_BEFORE_WORD}"
DIGIT_RUN = rf"{NOT_AFTER_WORD}\d[\d \-]{{5,}}\d{NOT_BEFORE_WORD}"
MONTHS = (
    r"jan(?:vier|uary)?|f[eé]v(?:rier)?|feb(?:ruary)?|mar(?:s|ch)?|avr(?:il)?|apr(?:il)?|mai|may|juin|june|juil(?:let)?|jul(?:y)?|ao[uû]t|aug(?:ust)?"
    r"|sep(?:t(?:embre|ember)?)?|oct(?:obre|ober)?|nov(?:embre|ember)?|d[eé]c(?:embre|ember)?"
)
DATE = (
    rf"(?iu){NOT_AFTER_WORD}(?:\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}|(?:{MONTHS})\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}"
    rf"|\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}}){NOT_BEFORE_WORD}"
)
BIRTH_CUE = r"(?iu)(?:\bn(?:ée?|ee)\b|\bnaissance\b|\bborn\b|\bbirth(?:day|date)?\b|\bdob\b|date\s+de\s+naissance|date\s+of\s+birth)"
BIRTH_WINDOW = 48
BUSINESS_SUFFIX = r"(?i)^[ \-]?(?:RT|RP|RC|RZ|RM|RR|RG)[ \-]?\d{4}(?!\d)"
SIN_CUE = r"(?iu)(?:(?<![a-z])(?:n\.?a\.?s|s\.?i\.?n)(?![a-z])|social\s*insurance|assurance\s*sociale|num[ée]ro\s*d.?assurance)"
SIN_WINDOW = 40
ID_CUE = (
    r"(?iu)(?<![a-z0-9é])(?:r[ée]f(?:[ée]rence)?|confirmation|transaction|virement|transfert|transfer|interac|paiement|payment|ch[èe]que|cheque|facture"
    r"|invoice|dossier|folio|compte|account|acct|transit|autorisation|authorization|mandat|num[ée]ro|n°|nas|sin|sdi|imp[oô]t|ramq|iban)(?![a-z])"
)
LONG_ID = r"(?<!\d)\d(?:[ \-]?\d){8,18}(?!\d)"
CUE_BEFORE, CUE_AFTER = 24, 12
GLUED_CARD = r"(?<!\d)\d[\d -]{13,18}\d(?!\d)"
GLUED_IBAN = r"(?i)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Z0-9])"
GLUED_DIGITS = r"(?<!\d)\d{9}(?!\d)"
CARD_SEPARATOR = r"(?:[ .\-]|%20)"
SEPARATED_CARD = rf"(?<![\d.])(?:\d{{4}}(?:{CARD_SEPARATOR}\d{{4}}){{3}}|\d{{4}}{CARD_SEPARATOR}\d{{6}}{CARD_SEPARATOR}\d{{5}})(?![\d.])"
DOTTED_SSN = r"(?<![\d.])\d{3}\.\d{2}\.\d{4}(?![\d.])"
QUOTED_SEPARATOR = r"\s*(?:no\.?|num(?:[ée]ro)?|#)?\s*[\"']?\s*[:=#-]?\s*[\"']?\s*"
CVV = (
    r"(?iu)(?:cvv2?|cvc2?|security[\s_]*code|card[\s_]*verification(?:[\s_]*(?:code|value))?|code\s*de\s*s[eé]curit[eé]|cryptogramme(?:\s*visuel)?)"
    rf"{QUOTED_SEPARATOR}(\d{{3,4}})(?!\d)"
)
EXPIRY = (
    r"(?iu)(?:exp(?:iry|ires?|iration)?|exp\.?\s*date|valid\s*thru|valid\s*through|good\s*thru|valable\s*jusqu.?(?:au)?|[ée]ch[ée]ance|date\s*d.?expiration)"
    r"\s*[\"']?\s*[:=#-]?\s*[\"']?\s*((?:0[1-9]|1[0-2])\s*[/\-]\s*(?:\d{4}|\d{2}))(?!\d)"
)
NUMERIC_SECRET = (
    r"(?iu)(?:(?:\b\w+_)?pin\b|\bnip\b|\bpasscode\b|\bpass[\s_]*code\b|\botp\b|\bone[\s_-]?time[\s_]*(?:code|password|passcode|pin)\b|\baccess[\s_]*code\b)"
    rf"{QUOTED_SEPARATOR}(\d{{3,8}})(?!\d)"
)
US_STATES = (
    "AL AK AZ AR CA CO CT DC DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()
US_ZIP_STATE = rf",\s*(?:{'|'.join(US_STATES)})\s+(\d{{5}}(?:-\d{{4}})?)(?!\d)"
US_ZIP_WORD = r"(?i)\bzip(?:\s?code)?\s*:?\s*(\d{5}(?:-\d{4})?)(?!\d)"
HEALTH_CARD = r"\b[A-Z]{4} \d{4} ?\d{4}\b"
DRIVER_LICENCE, DRIVER_CUE = r"(?<![A-Za-z0-9])[A-Za-z]\d{12}(?![A-Za-z0-9])", r"(?iu)(?<![a-z0-9é])(?:permis|licen[cs]e|saaq)(?![a-z])"
ENTERPRISE, ENTERPRISE_CUE = r"(?<![A-Za-z0-9])\d{10}(?![A-Za-z0-9])", r"(?iu)(?<![a-z0-9é])(?:neq|entreprise|registraire)(?![a-z])"

# Cue, separator and value on one line: label, cue, value, least digits.
CUE_SEPARATOR = r"[ \t]*[:#=|]?[ \t]*"
CUE_MONTHS = (
    r"janv(?:ier)?|f[ée]vr(?:ier)?|mars|avril|mai|juin|juil(?:let)?|ao[ûu]t|sept(?:embre)?|oct(?:obre)?|nov(?:embre)?|d[ée]c(?:embre)?"
    r"|january|february|march|april|may|june|july|august|september|october|november|december"
)
CUE_DATE = rf"(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}}|(?:{CUE_MONTHS})\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}(?:er)?\s+(?:{CUE_MONTHS})\.?\s+\d{{4}})"
CUE_RULES = (
    ("sensitive_account_id", r"(?:code\s+d[' ]acc[eè]s\s+netfile|netfile\s+access\s+code)", r"[A-Z0-9]{6,12}", 1),
    (
        "sensitive_account_id",
        r"(?:num[ée]ro\s+de\s+police|no\.?\s+de\s+police|policy\s+(?:number|no\.?)|num[ée]ro\s+du\s+document(?:\s+d[ée]livr[ée])?|issued\s+document\s+number"
        r"|num[ée]ro\s+de\s+dossier|no\.?\s+de\s+dossier|(?:credit\s+)?file\s+(?:number|no\.?))",
        r"[A-Z0-9][\dA-Z -]{3,20}[\dA-Z]",
        2,
    ),
    (
        "account_number",
        r"(?:num[ée]ro\s+de\s+compte|no\.?\s+de\s+compte|compte(?:\s+ch[eè]que)?|account\s+(?:number|no\.?)|acct\.?|folio)",
        r"\d(?:[ -]?\d){4,16}",
        5,
    ),
    (
        "phone_number",
        r"(?:t[ée]l[ée]phone|t[ée]l\.?|telephone|cellular|cellulaire|mobile|num[ée]ro\s+de\s+service|(?:subscriber\s+)?service\s+number)[,]?",
        r"(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}",
        10,
    ),
    ("date_of_birth", r"(?:n[ée]\(?e?\)?\s+le|born(?:\s+on)?|date\s+de\s+naissance|date\s+of\s+birth|dob|naissance)", CUE_DATE, 4),
)

# Labels that are redacted under every policy, can't be exempted and win a merge.
FLOOR_LABELS = (
    "secret", "password", "api_key", "access_token", "payment_card", "card_cvv", "card_expiry", "sensitive_account_id", "account_number", "bank_account",
    "iban", "routing_number", "government_id", "tax_id", "date_of_birth",
)
CUSTOM_LABEL = "custom"
CATEGORIES = {
    "person": ("person",), "address": ("address",), "phone": ("phone_number",), "email": ("email",),
    "account": ("sensitive_account_id", "account_number", "bank_account", "iban", "routing_number"),
    "nas": ("government_id",), "tax": ("tax_id",), "card": ("payment_card", "card_cvv", "card_expiry"),
    "dob": ("date_of_birth",), "date": ("sensitive_date",), "postal": ("postal_code",), "ip": ("ip_address",),
    "org": ("organization",), "filepath": ("file_path",), "username": ("username",), "uuid": ("uuid",), "ref": ("sensitive_ref",),
}
CASE_SENSITIVE_LABELS = ("password", "secret", "username", "person", "name", "access_token", "api_key", "file_path")
PLACEHOLDER = r"<[A-Z][A-Z0-9_]*_\d{3,}>"
BENIGN_HASH = r"^(?:[0-9a-f]{40}|[0-9a-f]{64})\z"
HOME_USER = r"(?i)(?:[\\/]+home[\\/]+|(?:[A-Za-z]:)?[\\/]+users[\\/]+|~)([^\\/\s]+)"
LEAST_SWEPT = 4
MODEL_IDENTITY = ("sensitive_account_id", "account_number", "bank_account", "iban", "routing_number", "government_id", "tax_id")
MODEL_CREDENTIAL = ("secret", "password", "api_key", "access_token")
CREDENTIAL_PREFIXES = (
    "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "akia", "asia", "aiza", "ya29.", "npm_", "pypi-", "eyj", "glpat-", "rk_live_", "rk_test_",
)

# Names of JSON keys whose values are sensitive whatever they look like.
SECRET_KEY = (
    r"(?i)(?:^|[_\-.])(?:passw(?:or)?d|pwd|secret|secret[_-]?key|api[_-]?key|apikey|access[_-]?key|access[_-]?token|refresh[_-]?token|id[_-]?token|auth[_-]?token"
    r"|authorization|client[_-]?secret|private[_-]?key|motdepasse|mot[_\-.]?de[_\-.]?passe|mdp|jeton|pin|account[_-]?pin|card[_-]?pin|nip|passcode|pass[_-]?code|otp)(?:$|[_\-.])"
)
CARD_KEY = (
    r"(?i)(?:^|[_\-.])(?:card[_-]?(?:number|num|no|pan)|cardnumber|pan|cvv2?|cvc2?|card[_-]?cvv|card[_-]?cvc|security[_-]?code|sec[_-]?code|cvv[_-]?code"
    r"|card[_-]?expir(?:y|ation)?|exp[_-]?date|expir(?:y|ation)|card[_-]?exp)(?:$|[_\-.])"
)
GOVERNMENT_KEY = r"(?i)(?:^|[_\-.])(?:ssn|sin|nas|social[_-]?security(?:[_-]?(?:number|no))?|national[_-]?id|numero[_-]?assurance[_-]?sociale)(?:$|[_\-.])"
BIRTH_KEY = r"(?i)(?:^|[_\-.])(?:dob|date[_-]?of[_-]?birth|birth[_-]?date|birthdate|date[_-]?de[_-]?naissance)(?:$|[_\-.])"

# Names next to a cue.
EMAIL_ANCHOR = r"<[ \t]*[\w.+-]+@[\w-]+\.[\w.-]+[ \t]*>"
HEADER_CUE = (
    r"(?im)^[ \t]*(?:from|to|cc|bcc|reply-to|sender|author|co-authored-by|signed-off-by|owner|titulaire|propri[ée]taire|attn|attention|nom|client(?:e)?|membre"
    r"|member|account\s+holder|prepared\s+for|pr[ée]par[ée]\s+pour)[ \t]*:[ \t]*"
)
LEDGER_CUE = (
    r"(?i)(?:vir\s+interac\s+(?:dep\s+auto\s+rec|recu|re[çc]u|envoy[eé]|annul[eé])|interac\s+(?:etrnsfr|etrnsr)\s+(?:ad\s+recvd|recvd|sent)"
    r"|d[eé]p[oô]t\s+auto\s*-\s*virements?\s+par\s+courriel|virement\s+(?:en\s+ligne\s+)?(?:envoy[eé]|recu|re[çc]u)|e-?transfer\s*-\s*autodeposit"
    r"|e-?transfer\s+sent|e-?transfer\s+(?:to|from)\s*:|e-?transfer\s+\d{6,}(?:\s*[;:,]\s*|\s+))[ \t]*"
)
LEDGER_SLASH_CUE = r"(?i)(?:(?:cancellation[ \-]*)?interac\s+e-?transfer\s+(?:from|to)|rent\s*/\s*lease)\s*/\s*"
NAME_TOKEN = r"[^\W\d_]+(?:['’.\-][^\W\d_]+)*"
NAME_PARTICLES = frozenset("van von de der den del della di da du la le el bin ibn al dos das do of and".split())
ROLE_WORDS = frozenset(
    "support sales billing info admin noreply no-reply notifications notification team contact hello help marketing security abuse postmaster mailer-daemon"
    " do-not-reply donotreply newsletter accounts service services sender recipient no_reply".split()
)
LEDGER_STOP_WORDS = frozenset(
    "fonds admis ca no ref reference cad usd id conf confirmation interac etrnsr etransfer transfer transfert virement virements vir dep auto rec recu reçu recvd"
    " received sent envoye envoyé envoi annule annulé autodeposit deposit depot dépôt courriel par en ligne from to cancellation rent lease prepared préparé pour"
    " nom client cliente membre member me ing inc ltd ltee ltée corp dollars dollar euros euro cents cts the a an my your this that account compte amount montant"
    " solde achat paiement retrait frais cheque chèque facture remboursement retour total balance".split()
)
HONORIFICS = frozenset("mme mlle mr mrs ms dr madame monsieur".split())

# Words that a person's name never grows over and that aren't propagated.
STATUS_WORDS = frozenset(
    "error errors warning warn info debug trace fatal panic exception traceback failed failure fail retry retrying timeout denied invalid unknown null none true"
    " false undefined nan success started stopped killed deprecated todo fixme notice pending alert critical severe erreur erreurs avertissement attention reessayer"
    " réessayer succes succès echec échec demarre démarré arrete arrêté termine terminé annulation refuse refusé valide validé expire expiré".split()
)
PROPAGATED_LABELS, PROPAGATED_CONF = ("person", "organization", "username", "address"), 0.75

# Request bodies. Names that the providers' protocols give a meaning to.
TEXT_BLOCKS = ("text", "input_text", "output_text")
BINARY_BLOCKS = ("image", "input_image", "image_url", "document", "redacted_thinking", "thinking")
FILE_BLOCKS = ("input_file", "file")
FILE_NAME_KEYS = ("filename", "file_name", "name")
#: Structure of a request or of a JSON schema: never text of a user where the protocol puts them.
STRUCTURAL_KEYS = frozenset((
    "type", "role", "id", "object", "status", "model", "name", "image_url", "file_url", "mime_type",
    "mimetype", "encoding", "format", "detail", "tool_choice", "service_tier", "output_index", "content_index",
    "index", "file_data", "version", "server_label", "server_url", "vector_store_ids", "allowed_tools",
    "connector_id", "authorization", "container", "container_id", "partial_images", "background", "verbosity",
    "properties", "required", "pattern", "additionalProperties", "$ref", "$defs", "parameters", "strict",
    "syntax", "definition",
))
#: Keys that route a request wherever they stand: a changed value breaks it.
ROUTING_KEYS = frozenset(("file_id", "container_id", "call_id", "item_id", "response_id", "previous_response_id", "connector_id", "image_url", "file_url", "server_url"))
OPAQUE_KEYS = frozenset(("encrypted_content",))
SCHEMA_KEYS = frozenset(("parameters", "schema", "input_schema"))
OUTPUT_KEYS = frozenset(("output", "outputs", "variables"))
LITERAL_KEYS = frozenset(("enum", "const"))
#: Files that are text, by MIME type, end of the name, or whole name; and ends of names that are not.
TEXT_MIMES = frozenset((
    "application/json", "application/x-ndjson", "application/xml", "application/x-yaml", "application/yaml",
    "application/toml", "application/x-sh", "application/javascript", "application/x-javascript",
    "application/typescript", "application/x-python", "application/x-httpd-php", "application/sql",
    "application/csv", "application/x-csv", "image/svg+xml",
))
TEXT_ENDS = (
    ".txt", ".md", ".markdown", ".csv", ".tsv", ".json", ".jsonl", ".ndjson", ".xml", ".yaml", ".yml", ".toml",
    ".ini", ".cfg", ".conf", ".log", ".html", ".htm", ".css", ".svg", ".rst", ".tex",
    ".py", ".pyi", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".go", ".rs", ".rb", ".php", ".java", ".kt",
    ".kts", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".swift", ".scala", ".sh", ".bash", ".zsh", ".fish",
    ".ps1", ".sql", ".r", ".lua", ".pl", ".dart", ".vue", ".svelte", ".tf", ".dockerfile", ".env", ".gradle",
    ".properties", ".gitignore", ".editorconfig",
)
TEXT_NAMES = frozenset((
    "dockerfile", "containerfile", "makefile", "gnumakefile", "cmakelists.txt", "rakefile", "gemfile", "guardfile",
    "procfile", "vagrantfile", "brewfile", "jenkinsfile", "justfile", "caddyfile", "license", "licence", "notice",
    "copying", "authors", "contributors", "readme", "changelog", "changes", "history", "manifest", "todo",
    "codeowners", ".gitignore", ".gitattributes", ".dockerignore", ".npmignore", ".editorconfig", ".env",
    ".bashrc", ".zshrc", ".profile", ".babelrc", ".eslintrc", ".prettierrc",
))
BINARY_ENDS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tiff", ".tif", ".ico", ".heic", ".heif", ".avif",
    ".pdf", ".zip", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".rar", ".tar", ".jar", ".war", ".class", ".exe",
    ".dll", ".so", ".dylib", ".o", ".a", ".bin", ".dat", ".wasm", ".mp3", ".mp4", ".wav", ".flac", ".ogg",
    ".mov", ".avi", ".mkv", ".webm", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods",
    ".ttf", ".otf", ".woff", ".woff2", ".eot", ".db", ".sqlite", ".sqlite3", ".pkl", ".pickle", ".npy", ".npz",
)
