"""The request by which each provider is asked about a value."""

# Provider, method, address, how the value is sent, other headers, body. In addresses and in what is sent, M is the
# value found and names in braces are values paired with it.
ENDPOINTS = [
    ("github", "GET", "https://api.github.com/user", "bearer", {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28"}, None),
    ("gitlab", "GET", "https://gitlab.com/api/v4/user", "header PRIVATE-TOKEN", {}, None),
    ("stripe", "GET", "https://api.stripe.com/v1/balance", "basic M:", {}, None),
    ("openai", "GET", "https://api.openai.com/v1/models", "bearer", {}, None),
    ("anthropic", "GET", "https://api.anthropic.com/v1/models", "header x-api-key", {"anthropic-version": "2023-06-01"}, None),
    ("slack", "POST", "https://slack.com/api/auth.test", "bearer", {}, None),
    ("aws", "POST", "https://sts.amazonaws.com/", "signed", {"content-type": "application/x-www-form-urlencoded; charset=utf-8", "host": "sts.amazonaws.com"}, "Action=GetCallerIdentity&Version=2011-06-15"),
    ("twilio", "GET", "https://api.twilio.com/2010-04-01/Accounts.json", "basic M:{TWILIO_AUTH_TOKEN}", {}, None),
    ("sendgrid", "GET", "https://api.sendgrid.com/v3/scopes", "bearer", {}, None),
    ("mailgun", "GET", "https://api.mailgun.net/v3/domains", "basic api:M", {}, None),
    ("datadog", "GET", "https://api.datadoghq.com/api/v1/validate", "header DD-API-KEY", {}, None),
    ("heroku", "GET", "https://api.heroku.com/account", "bearer", {"Accept": "application/vnd.heroku+json; version=3"}, None),
    ("npm", "GET", "https://registry.npmjs.org/-/whoami", "bearer", {}, None),
    ("pypi", "POST", "https://upload.pypi.org/legacy/", "basic __token__:M", {}, ""),
    ("digitalocean", "GET", "https://api.digitalocean.com/v2/account", "bearer", {}, None),
    ("huggingface", "GET", "https://huggingface.co/api/whoami-v2", "bearer", {}, None),
    ("square", "GET", "https://connect.squareup.com/v2/locations", "bearer", {"Square-Version": "2024-06-04"}, None),
    ("linear", "POST", "https://api.linear.app/graphql", "header Authorization", {"Content-Type": "application/json"}, '{"query":"{ viewer { id } }"}'),
    ("notion", "GET", "https://api.notion.com/v1/users/me", "bearer", {"Notion-Version": "2022-06-28"}, None),
    ("postman", "GET", "https://api.getpostman.com/me", "header X-Api-Key", {}, None),
    ("figma", "GET", "https://api.figma.com/v1/me", "header X-Figma-Token", {}, None),
    ("replicate", "GET", "https://api.replicate.com/v1/account", "bearer", {}, None),
    ("groq", "GET", "https://api.groq.com/openai/v1/models", "bearer", {}, None),
    ("shopify", "GET", "https://{SHOPIFY_DOMAIN}/admin/api/2024-04/shop.json", "header X-Shopify-Access-Token", {}, None),
    ("databricks", "GET", "https://{DATABRICKS_HOST}/api/2.0/preview/scim/v2/Me", "bearer", {}, None),
]
#: Pattern or tenant provider to the name under which its value is paired; and what a name may stand for besides.
PAIR_NAMES = {"aws_secret_key": "AWS_SECRET_ACCESS_KEY", "aws_session_token": "AWS_SESSION_TOKEN", "shopify": "SHOPIFY_DOMAIN", "databricks": "DATABRICKS_HOST"}
OTHER_NAMES = {"TWILIO_AUTH_TOKEN": "TWILIO_API_SECRET"}
#: Of signed requests: the region, the service, and what signing needs.
REGION, SERVICE, SIGNING_NAME, TOKEN_NAME = "us-east-1", "sts", "AWS_SECRET_ACCESS_KEY", "AWS_SESSION_TOKEN"
