"""Word lists, lookup tables and patterns that results depend on.

They are stated as they must be, in natural order, and hold no logic.
"""

MISSING_WORDS = ["", "unknown", "none", "null", "nan", "n/a", "na"]
MISSING_WORDS_EXTRACTION = ["", "unknown", "nan", "none", "null", "[]"]
MISSING_WORDS_PREFILL = ["", "unknown", "none", "null", "n/a"]
TRUE_WORDS = ["1", "true", "yes", "y", "t"]

STRUCTURED_SOURCES = ["hh_kz", "kaspi_jobs", "kolesa_jobs"]
SOURCE_FAMILY = {"hh_kz": "hh_kz", "kaspi_jobs": "kaspi", "kolesa_jobs": "kolesa"}
SOURCE_PRIORITY = {
    "hh_kz": 4,
    "kaspi_jobs": 3,
    "kolesa_jobs": 3,
    "Freedom Broker": 2,
    "Work IT KZ": 1,
    "Zhumys Bar IT": 1,
    "IT Vacancy KZ": 1,
    "ITcom KZ": 1,
    "Halyk Jumys": 1,
    "Insfera For You": 1,
}

CATEGORIES = [
    "data", "software_engineering", "qa", "devops", "product", "design", "analytics", "security",
    "management", "support", "marketing", "sales", "hr", "finance", "other",
]
LEVELS = ["intern", "junior", "middle", "senior", "lead", "manager"]
EMPLOYMENTS = ["full_time", "part_time", "contract", "internship", "temporary"]
WORK_FORMATS = ["office", "remote", "hybrid"]
ENGLISH_LEVELS = ["a1", "a2", "b1", "b2", "c1", "c2", "not_required"]
CURRENCIES_V1 = ["KZT", "USD", "EUR", "RUB", "KGS"]
CURRENCIES_V3 = ["KZT", "USD", "EUR", "RUB", "KGS", "GBP"]
LEVEL_ORDER = ["intern", "junior", "middle", "senior", "lead", "manager"]
WORK_FORMAT_ORDER = ["office", "hybrid", "remote"]
QUALITY_ORDER = ["A", "B", "C", "D"]
CITY_ORDER = ["almaty", "astana", "other", "remote"]
SALARY_OUTLIER = 10_000_000

CATEGORY_ALIASES = {
    "backend": "software_engineering",
    "frontend": "software_engineering",
    "front_end": "software_engineering",
    "fullstack": "software_engineering",
    "mobile": "software_engineering",
    "java_engineer": "software_engineering",
    "python_developer": "software_engineering",
    "dotnet_developer": "software_engineering",
    "data_analyst": "analytics",
    "data_engineer": "data",
    "data_scientist": "data",
    "ml_engineer": "data",
    "product_analyst": "analytics",
    "business_analyst": "analytics",
    "system_analyst": "analytics",
    "project_manager": "management",
    "product_manager": "product",
    "ui_ux_designer": "design",
    "head": "management",
}
LEVEL_ALIASES = {
    "mid": "middle",
    "middle+": "middle",
    "middle plus": "middle",
    "sr": "senior",
    "senior+": "senior",
    "jr": "junior",
    "head": "manager",
}
EMPLOYMENT_ALIASES = {
    "fulltime": "full_time",
    "full_time": "full_time",
    "parttime": "part_time",
    "part_time": "part_time",
    "freelance": "contract",
    "contractor": "contract",
    "intern": "internship",
}
CURRENCY_ALIASES = {
    "KZT": "KZT",
    "ТГ": "KZT",
    "ТЕНГЕ": "KZT",
    "KGS": "KGS",
    "USD": "USD",
    "$": "USD",
    "EUR": "EUR",
    "€": "EUR",
    "RUR": "RUB",
    "RUB": "RUB",
    "РУБ": "RUB",
}
SKILL_FAMILY_WORDS = [
    ("language", ["python", "java", "go", "scala", "c#", "php", "sql", "javascript", "typescript"]),
    ("framework", ["react", "vue", "angular", "django", "flask", "spring", "fastapi", "laravel"]),
    ("cloud_devops", ["docker", "kubernetes", "aws", "azure", "gcp", "terraform", "airflow", "jenkins"]),
    ("analytics_bi", ["power bi", "tableau", "looker", "superset", "excel", "etl", "dbt"]),
]

WORK_FORMAT_WORDS = [
    ("hybrid", ["гибрид", "hybrid"]),
    ("remote", ["удален", "remote", "дистанцион", "home office", "work from home"]),
    ("office", ["офис", "office", "onsite", "on-site", "в офисе", "на месте"]),
]
WORK_FORMAT_KEY_WORDS = [
    ("hybrid", ["hybrid", "гибрид"]),
    ("remote", ["remote", "удален", "дистанцион"]),
    ("office", ["office", "onsite", "on_site", "офис"]),
]
CITY_WORDS = [
    ("almaty", ["алматы", "almaty"]),
    ("astana", ["астана", "astana", "nur-sultan", "нур-султан"]),
    ("remote", ["remote", "удален", "дистанцион"]),
]
EMPLOYMENT_WORDS = [
    ("full_time", ["полная", "full time", "full-time", "fulltime"]),
    ("part_time", ["частичная", "part time", "part-time", "parttime"]),
    ("contract", ["contract", "контракт", "contractor"]),
    ("internship", ["intern", "стаж", "internship"]),
    ("temporary", ["temporary", "временн"]),
    ("contract", ["freelance", "freelancer", "project"]),
]
CURRENCY_WORDS_V1 = [
    ("KZT", ["KZT", "₸", "ТГ", "ТЕНГЕ"]),
    ("USD", ["USD", "$"]),
    ("EUR", ["EUR", "€"]),
    ("RUB", ["RUB", "RUR", "РУБ"]),
    ("KGS", ["KGS"]),
]
CURRENCY_WORDS_V3 = [
    ("KZT", ["KZT", "₸", "ТГ", "ТЕНГЕ"]),
    ("USD", ["USD", "$"]),
    ("EUR", ["EUR", "€"]),
    ("GBP", ["GBP", "£"]),
    ("RUB", ["RUB", "RUR", "РУБ", "₽"]),
    ("KGS", ["KGS"]),
]
CURRENCY_WORDS_SIMPLE = [
    ("KZT", ["тенге", "тг", "₸"]),
    ("USD", ["usd", "$"]),
    ("EUR", ["eur", "€"]),
    ("RUB", ["rub", "rur", "руб"]),
]
CHAT_KEYWORDS = ["вакансия", "требуется", "нужен", "опыт", "зарплата", "job", "developer", "engineer"]
ENGLISH_WORDS = ["english", "англий"]
ENGLISH_REQUIRED_WORDS = ["required", "требуется", "must have", "обязательно"]

SKILL_ALIASES = {
    "git": "Git",
    "python": "Python",
    "postgres": "PostgreSQL",
    "postgresql": "PostgreSQL",
    "py spark": "PySpark",
    "pyspark": "PySpark",
    "k8s": "Kubernetes",
    "kubernetes": "Kubernetes",
    "1с": "1C",
    "1c": "1C",
    "react.js": "React",
    "reactjs": "React",
    "node.js": "Node.js",
    "nodejs": "Node.js",
    "ci cd": "CI/CD",
    "ci/cd": "CI/CD",
    "cicd": "CI/CD",
}
SKILL_TITLES = {
    "sql": "SQL",
    "excel": "Excel",
    "docker": "Docker",
    "linux": "Linux",
    "power bi": "Power BI",
    "figma": "Figma",
    "django": "Django",
    "flask": "Flask",
    "airflow": "Apache Airflow",
    "tableau": "Tableau",
}
JS_CONTEXT_WORDS = [
    "developer", "frontend", "backend", "engineer", "react", "vue", "angular", "node", "typescript", "javascript",
    "програм", "разработ",
]
EXTRACTION_SKILL_ALIASES = {
    "postgres": "PostgreSQL",
    "postgresql": "PostgreSQL",
    "py spark": "PySpark",
    "pyspark": "PySpark",
    "k8s": "Kubernetes",
    "kubernetes": "Kubernetes",
}
EXTRACTION_JS_WORDS = [
    "developer", "engineer", "frontend", "backend", "react", "vue", "angular", "node", "typescript", "javascript", "web",
    "software", "programming",
]
SKILL_FAMILIES = {
    "Python": "data_and_backend",
    "SQL": "data_and_backend",
    "PostgreSQL": "data_and_backend",
    "PySpark": "data_and_backend",
    "Apache Airflow": "data_and_backend",
    "JavaScript": "frontend_and_web",
    "React": "frontend_and_web",
    "Node.js": "frontend_and_web",
    "TypeScript": "frontend_and_web",
    "Kubernetes": "devops_and_cloud",
    "Docker": "devops_and_cloud",
    "CI/CD": "devops_and_cloud",
    "Linux": "devops_and_cloud",
    "Selenium": "qa_and_testing",
    "Postman": "qa_and_testing",
    "Cypress": "qa_and_testing",
    "Power BI": "analytics_and_bi",
    "Tableau": "analytics_and_bi",
    "Figma": "design",
    "1C": "erp_and_business_systems",
}

# Category inference: (category, weight, words found anywhere in the text), in tie order.
CATEGORY_TEXT_RULES = [
    ("data", 4, ["data engineer", "data scientist", "ml engineer", "machine learning", "etl", "dwh"]),
    ("analytics", 4, ["data analyst", "business analyst", "system analyst", "product analyst", "bi analyst", "dashboard"]),
    ("qa", 5, ["qa engineer", "tester", "test automation", "selenium", "postman", "sdet"]),
    ("devops", 5, ["devops", "site reliability", "sre", "terraform", "kubernetes", "docker", "ci/cd", "ansible"]),
    ("product", 5, ["product manager", "product owner"]),
    ("management", 5, ["project manager", "team lead", "delivery manager", "engineering manager", "head of", "director"]),
    ("design", 5, ["ui/ux", "ux designer", "ui designer", "product designer", "figma"]),
    ("security", 5, ["security", "soc", "siem", "pentest", "cyber"]),
    ("support", 5, ["support", "helpdesk", "technical support"]),
    ("marketing", 4, ["marketing", "smm", "brand manager", "media planner"]),
    ("sales", 4, ["sales", "account executive", "business development", "head of sales"]),
    ("hr", 4, ["recruiter", "hr", "talent acquisition"]),
    ("finance", 4, ["finance", "accountant", "auditor", "financial analyst"]),
    ("software_engineering", 4, [
        "developer", "разработчик", "software engineer", "backend", "frontend", "fullstack", "mobile", "android", "ios"]),
]
CATEGORY_SKILL_RULES = [
    ("data", 2, ["python", "sql", "pyspark", "postgresql", "apache airflow"]),
    ("analytics", 2, ["power bi", "tableau"]),
    ("qa", 3, ["selenium", "postman", "cypress"]),
    ("devops", 3, ["docker", "kubernetes", "ci/cd", "linux"]),
    ("software_engineering", 2, ["react", "node.js", "javascript"]),
    ("design", 2, ["figma"]),
]

TITLE_VARIANTS = [
    ("Frontend Developer", r"\b(front[\s-]?end|react(?:\.js)? developer|vue(?:\.js)? developer|angular developer)\b"),
    ("Backend Developer", r"\b(back[\s-]?end|backend developer|python developer|java developer|golang developer|node(?:\.js)? developer|c#/.net software developer|php developer)\b"),
    ("Fullstack Developer", r"\bfull[\s-]?stack\b"),
    ("Data Analyst", r"\b(data analyst|bi analyst|business intelligence analyst)\b"),
    ("Business Analyst", r"\b(system analyst|business analyst|product analyst)\b"),
    ("Data Scientist", r"\bdata scientist\b"),
    ("ML Engineer", r"\b(machine learning engineer|ml engineer)\b"),
    ("Data Engineer", r"\b(data engineer)\b"),
    ("QA Engineer", r"\b(qa engineer|test automation engineer|tester|sdet|quality assurance)\b"),
    ("DevOps Engineer", r"\b(devops engineer|site reliability engineer|sre)\b"),
    ("Product Manager", r"\b(product manager|product owner)\b"),
    ("Project Manager", r"\b(project manager)\b"),
    ("UI/UX Designer", r"\b(ui/?ux designer|product designer|ux designer|ui designer)\b"),
]
TITLE_KEEP_WORDS = [
    ".net", "asp.net", "angular", "react", "vue", "java", "python", "golang", "c#", "c++", "node", "qa ", " ai", " ml",
    "senior", "middle", "junior", "lead", "fullstack", "/", "(",
]
TITLE_BAD_WORDS = [
    "ищет", "нужен", "нужна", "требуется", "вакансия", "должность", "компания", "разработчика", "разработчикa",
]
TITLE_BAD_ALONE = ["backend", "frontend", "fullstack", "developer", "engineer", "analyst"]
TITLE_BAD_PARTS = ["контакты:", "резюме", "whatsapp", "telegram", "@"]
TITLE_BAD_STARTS = ["всем привет", "друзья", "приветствую", "присоединяйтесь", "переходите по ссылке", "войди в it"]
TITLE_SENTENCE_WORDS = [
    "developer", "engineer", "manager", "analyst", "designer", "разработчик", "аналитик", "менеджер", "инженер", "дизайнер",
]
COMPANY_ALIASES = {"kaspi": "Kaspi.kz", "kaspi.kz": "Kaspi.kz", "tele2 altel": "Tele2/Altel", "tele2/altel": "Tele2/Altel"}
CONTACT_WORDS = r"(контакт[ыа]?|contact|contacts|whatsapp|telegram|tg|резюме|отправить резюме|write to|direct|send cv|cv|resume|whatsupp|whatsup)"
CONTACT_CLAUSE_WORDS = r"(контакт[ыа]?|contact|contacts|whatsapp|telegram|tg|резюме|отправить резюме|write to|direct|send cv|resume)"
PROMO_PHRASES = [
    r"\bapply now\b",
    r"\bno experience\?\s*no problem\b",
    r"\bwe['’]ll teach you everything you need to succeed\b",
    r"\bпишите в direct\b",
    r"\bоткликайтесь\b",
    r"\bждем ваше резюме\b",
]

# Extraction records: category aliases by category, and words searched in order when no alias fits.
EXTRACTION_CATEGORY_ALIASES = {
    "backend": "software_engineering",
    "backend_developer": "software_engineering",
    "backend_engineer": "software_engineering",
    "frontend": "software_engineering",
    "frontend_developer": "software_engineering",
    "frontend_engineer": "software_engineering",
    "fullstack": "software_engineering",
    "full_stack": "software_engineering",
    "fullstack_developer": "software_engineering",
    "mobile": "software_engineering",
    "android": "software_engineering",
    "ios": "software_engineering",
    "software": "software_engineering",
    "software_engineer": "software_engineering",
    "software_developer": "software_engineering",
    "web_development": "software_engineering",
    "web": "software_engineering",
    "engineering": "software_engineering",
    "data_engineer": "data",
    "data_analyst": "data",
    "data_scientist": "data",
    "ml": "data",
    "ai": "data",
    "ml_engineer": "data",
    "machine_learning": "data",
    "machine_learning_engineer": "data",
    "artificial_intelligence": "data",
    "bi": "data",
    "bi_analyst": "data",
    "business_intelligence": "data",
    "test": "qa",
    "testing": "qa",
    "quality_assurance": "qa",
    "test_automation": "qa",
    "sdet": "qa",
    "sre": "devops",
    "platform": "devops",
    "platform_engineering": "devops",
    "cloud": "devops",
    "cloud_engineering": "devops",
    "infrastructure": "devops",
    "infra": "devops",
    "product_manager": "product",
    "product_owner": "product",
    "project_management": "management",
    "project_manager": "management",
    "engineering_manager": "management",
    "delivery_manager": "management",
    "team_lead": "management",
    "leadership": "management",
    "business_analyst": "analytics",
    "system_analyst": "analytics",
    "systems_analyst": "analytics",
    "product_analyst": "analytics",
    "analyst": "analytics",
    "ux": "design",
    "ui": "design",
    "ui_ux": "design",
    "ux_ui": "design",
    "product_design": "design",
    "product_designer": "design",
    "graphic_design": "design",
    "motion_design": "design",
    "cybersecurity": "security",
    "information_security": "security",
    "infosec": "security",
    "soc": "security",
    "customer_support": "support",
    "technical_support": "support",
    "helpdesk": "support",
    "service_desk": "support",
    "smm": "marketing",
    "performance_marketing": "marketing",
    "digital_marketing": "marketing",
    "growth": "marketing",
    "sales_manager": "sales",
    "business_development": "sales",
    "account_executive": "sales",
    "recruiting": "hr",
    "recruiter": "hr",
    "talent_acquisition": "hr",
    "accounting": "finance",
    "accountant": "finance",
    "financial_analyst": "finance",
    "finops": "finance",
}
EXTRACTION_CATEGORY_WORDS = [
    ("software_engineering", [
        "backend", "frontend", "fullstack", "mobile", "software", "developer", "programmer", "java", "python", "golang", "php",
        "dotnet", "csharp", "react", "angular", "vue"]),
    ("data", ["data", "ml", "machine_learning", "ai", "analytics_engineer", "bi"]),
    ("qa", ["qa", "test", "testing", "sdet"]),
    ("devops", ["devops", "sre", "platform", "cloud", "infra", "infrastructure"]),
    ("product", ["product"]),
    ("management", ["manager", "lead", "delivery"]),
    ("analytics", ["analyst", "analysis"]),
    ("design", ["design", "designer", "ux", "ui"]),
    ("security", ["security", "cyber", "infosec"]),
    ("support", ["support", "helpdesk", "service_desk"]),
    ("marketing", ["marketing", "smm", "growth"]),
    ("sales", ["sales", "business_development"]),
    ("hr", ["hr", "recruit"]),
    ("finance", ["finance", "account", "finops"]),
]
EXTRACTION_ENGLISH_ALIASES = {
    "upper-intermediate": "b2",
    "upper_intermediate": "b2",
    "intermediate": "b1",
    "pre-intermediate": "a2",
    "pre_intermediate": "a2",
    "advanced": "c1",
    "elementary": "a2",
    "beginner": "a1",
}
EXTRACTION_PERIOD_ALIASES = {
    "час": "hour",
    "в_час": "hour",
    "hour": "hour",
    "hourly": "hour",
    "week": "week",
    "weekly": "week",
    "weekend": "week",
    "month": "month",
    "monthly": "month",
    "месяц": "month",
    "m": "month",
    "year": "year",
    "annual": "year",
    "yearly": "year",
    "год": "year",
}
EXTRACTION_CURRENCIES = ["KZT", "USD", "EUR", "RUB"]
PREFILL_WORK_FORMAT_WORDS = [
    ("hybrid", ["гибрид", "hybrid"]),
    ("remote", ["удален", "remote", "дистанцион", "work from home", "home office"]),
    ("office", ["onsite", "on-site", "офис", "office", "в офисе"]),
]
PREFILL_CURRENCY_WORDS = [
    ("KZT", ["KZT", "ТГ", "₸", "ТЕНГЕ"]),
    ("USD", ["USD", "$"]),
    ("EUR", ["EUR", "€"]),
    ("RUB", ["RUB", "RUR", "РУБ"]),
]
PREFILL_LABELS = {
    "company": "компания|company",
    "city": "город|city|location|локация",
    "employment": "занятость|employment",
    "work_format": "формат|work format|format",
    "salary_raw": "зарплата|salary",
    "experience": "опыт|experience",
}
