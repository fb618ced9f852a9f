"""The word lists and mappings that results depend on."""

# Fixed values.
EXTENSIONS = (
    "rb erb rake py pyi pyx js mjs cjs jsx ts tsx vue svelte go java kt kts scala rs ex exs ml mli clj cljs cljc php swift "
    "sh bash zsh fish pl pm lua c cc cpp h hpp cxx yml yaml toml json json5 ini conf properties xml tf tfvars hcl nomad "
    "md mdx txt rst gradle groovy dockerfile containerfile"
).split()
FIXTURE_PATHS = (
    "spec/ test/ tests/ __tests__/ fixtures/ examples/ docs/ doc/ example/ sample/ samples/ demo/ tutorial/ "
    ".env.example .env.sample .env.template mock/ mocks/ stub/ stubs/ dummy/"
).split()
APP_PATHS = "app/ lib/ src/ config/ cmd/ services/ pkg/ internal/".split()
DUMMY_MARKERS = (
    "example xxxx test_xxx placeholder redacted changeme change_me change-me your_ your- <your todo sample dummy fakekey "
    "fake_key notreal not_real donotuse do_not_use replaceme replace_me insert_your lorem"
).split()
ENV_REFERENCES = [
    "env[", "env.fetch", "process.env", "os.environ", "os.getenv", "system.getenv", "getenv(", "viper.get",
    "rails.application.credentials", "credentials.dig", "#{env", "<%= env",
]
PLACEHOLDERS = ["{{", "}}", "#{", "${", "%{", "<%=", "%s", "%d"]
REFERENCE_KEYS = "from_secret externalsecret external-secret secretkeyref valuefrom secretname secretref secret_ref".split()
SEVERITIES = ["unknown", "low", "medium", "high", "critical"]
LANGUAGES = {
    "ruby": "rb erb rake", "java_script": "js mjs cjs jsx vue svelte", "type_script": "ts tsx", "python": "py pyi pyx",
    "yaml": "yml yaml", "json": "json json5", "shell": "sh bash zsh fish", "go": "go", "java": "java", "kotlin": "kt kts",
    "scala": "scala", "rust": "rs", "php": "php",
}
#: How each language reads the variable N; the others cannot.
CALLS = {
    "ruby": "ENV.fetch('N')", "java_script": "process.env.N", "type_script": "process.env.N", "python": "os.environ['N']",
    "yaml": "${N}", "shell": "${N}", "go": 'os.Getenv("N")', "java": 'System.getenv("N")', "kotlin": 'System.getenv("N")',
    "scala": 'System.getenv("N")', "rust": 'std::env::var("N").expect("missing N")', "php": "getenv('N')",
}
#: The command that stores a value; N the name, D the name in lower case with dashes, P the place holder.
SEEDS = {
    "env": "export N=P", "vault": "vault kv put secret/app N=P", "doppler": "doppler secrets set N=P",
    "aws_secrets_manager": 'aws secretsmanager put-secret-value --secret-id D --secret-string "P"', "infisical": "infisical secrets set N=P",
}
#: provider, the patterns it verifies, statuses that mean invalid, the fields of a good answer that are kept.
PROVIDERS = [
    ("github", "github_token github_fine_grained", "401 403", "login id type"),
    ("gitlab", "gitlab_pat", "401", "id username"),
    ("stripe", "stripe_secret", "401 403", "livemode"),
    ("openai", "openai_key", "401 403", ""),
    ("anthropic", "anthropic_key", "401 403", ""),
    ("slack", "slack_token", "", "team user"),
    ("aws", "aws_access_key", "401 403", "account arn"),
    ("twilio", "twilio_key", "401 403", ""),
    ("sendgrid", "sendgrid_key", "401 403", ""),
    ("mailgun", "mailgun_key", "401 403", ""),
    ("datadog", "datadog_api_key", "401 403", ""),
    ("heroku", "heroku_api_key", "401 403", "id email name"),
    ("npm", "npm_token", "401 403", "username"),
    ("pypi", "pypi_token", "401", ""),
    ("digitalocean", "digitalocean_pat", "401 403", ""),
    ("huggingface", "huggingface_token", "401 403", "name"),
    ("square", "square_token square_access_token", "401 403", ""),
    ("linear", "linear_key", "400 401 403", ""),
    ("notion", "notion_token", "401 403", "id"),
    ("postman", "postman_key", "401 403", ""),
    ("figma", "figma_token", "401 403", "id email"),
    ("replicate", "replicate_token", "401 403", "username"),
    ("groq", "groq_key", "401 403", ""),
    ("shopify", "shopify_token", "401 403", "domain"),
    ("databricks", "databricks_token", "401 403", "userName"),
]
#: Patterns that nothing verifies; all others can fall back on an external scanner.
UNVERIFIED = (
    "perplexity_key gitlab_runner_token google_oauth_secret atlassian_token rubygems_key vault_token doppler_token planetscale_token "
    "supabase_token grafana_token tailscale_key newrelic_key sentry_token dropbox_token flutterwave_secret airtable_token brevo_key "
    "mailchimp_key discord_bot_token discord_webhook telegram_bot_token"
).split()
#: Confidence of each step of the classification.
CONFIDENCE = {
    "catalog_fixture": 1.0, "catalog_leaked": 1.0, "catalog_honeytoken": 1.0, "verified": 1.0, "invalid": 0.85, "fixture_path": 0.7,
    "dummy": 0.9, "env_reference": 0.95, "placeholder": 0.9, "secret_reference": 0.9, "app_path": 0.65, "inconclusive": 0.3,
}
