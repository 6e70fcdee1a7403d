"""Rule data: fixed values that results depend on, in their natural order."""

from __future__ import annotations

# Parameter names removed by the conservative tier, and the base domain it leaves alone.
CONSERVATIVE_PARAMETERS = (
    "gclid", "dclid", "msclkid", "_openstat", "yclid", "wickedid", "twclid", "_hsenc", "__hssc", "__hstc", "__hsfp",
    "hsctatracking", "wbraid", "gbraid", "ysclid", "mc_eid", "oly_anon_id", "oly_enc_id", "__s", "vero_id", "mkt_tok", "fbclid",
)
ALLOWED_BASE_DOMAINS = ("googleadservices.com",)

# The aggressive tier's rules; the first that matches a lower-cased name gives its id.
AGGRESSIVE_PARAMETERS = (
    ("campaign:utm", "utm(?:_[a-z0-9_-]*)?"),
    ("campaign:mtm", "mtm(?:_[a-z0-9_-]*)?"),
    ("campaign:itm", "itm_[a-z0-9_-]+"),
    ("campaign:otm", "otm_[a-z0-9_-]*"),
    ("campaign:ga", "ga_[a-z0-9_-]+"),
    ("hubspot:hsa", "hsa_[a-z0-9_-]+"),
    ("email:bsft", "bsft_[a-z0-9_-]+"),
    ("adjust:campaign", "(?:adj|adjust)_[a-z0-9_-]+"),
    ("adobe:coremetrics", "cm_mmc(?:[a-z0-9_-]*)"),
    ("facebook:action", "(?:fb_action_(?:types|ids)|action_(?:object|type|ref)_map)"),
    ("email:mc", "mc_(?:cid|eid|tc)"),
    ("tracking:known-name", "(?:_ga|_gl|__twitter_impression|adobe_mc_ref|adobe_mc_sdid|awc|cmpid|dclid|fbclid|gclid|gclsrc|gbraid|msclkid|s_cid|srsltid|tgclid|ttclid|twclid|wbraid|yclid|ysclid)"),
    ("tracking:known-click-id", "(?:admitad_uid|aiad_clid|clickid|external_click_id|iclid|irclickid|rb_clickid|rtkcid|sscid|unicorn_click_id|wickedid)"),
    ("tracking:email", "(?:_clde|_cldee|_ope|elq|elqaid|elqat|elqcampaignid|elqtrackid|eml-mediaplan|eml-name|eml-publisher|mkt_tok|ml_subscriber|ml_subscriber_hash|oly_anon_id|oly_enc_id|vero_conv|vero_id)"),
    ("tracking:analytics", "(?:_openstat|clckid|cx_recswidget|dpg_(?:campaign|content|medium|source)|gs_l|hmb_(?:campaign|medium|source)|hsctatracking|oprtrack|tracking_source|usqp|wt_?z?mc|wtrid|ym_tracking_id)"),
)

# Static redirect wrappers: id, exact hosts, host suffix, paths, parameters.
REDIRECTS = (
    ("unwrap:google", ("google.com", "www.google.com"), None, ("/url",), ("url", "q")),
    ("unwrap:googleadservices", (), "googleadservices.com", None, ("adurl",)),
    ("unwrap:youtube", (), "youtube.com", ("/redirect",), ("q",)),
    ("unwrap:facebook", ("l.facebook.com", "lm.facebook.com"), None, ("/l.php",), ("u",)),
    ("unwrap:reddit", ("out.reddit.com", "click.redditmail.com"), None, None, ("url",)),
    ("unwrap:steam", ("steamcommunity.com",), None, ("/linkfilter/",), ("url",)),
    ("unwrap:microsoft-safelinks", (), "safelinks.protection.outlook.com", None, ("url",)),
)

# Shop domains with product paths, and index files.
AMAZON_DOMAINS = (
    "amazon.ae", "amazon.ca", "amazon.cn", "amazon.co.jp", "amazon.co.uk", "amazon.com", "amazon.com.au", "amazon.com.be",
    "amazon.com.br", "amazon.com.mx", "amazon.com.tr", "amazon.de", "amazon.eg", "amazon.es", "amazon.fr", "amazon.in",
    "amazon.it", "amazon.nl", "amazon.pl", "amazon.sa", "amazon.se", "amazon.sg",
)
INDEX_FILES = ("index.html", "index.htm", "index.php", "default.html", "default.htm", "default.asp", "default.aspx")

# Parameters that accompany a signature.
AWS_V4 = ("x-amz-algorithm", "x-amz-credential", "x-amz-date", "x-amz-expires", "x-amz-signedheaders")
GOOGLE_V4 = ("x-goog-algorithm", "x-goog-credential", "x-goog-date", "x-goog-expires", "x-goog-signedheaders")
AZURE_SAS = ("se", "si", "skoid", "sp", "sr", "srt", "ss")
AZURE_HOSTS = (".core.windows.net", ".core.usgovcloudapi.net", ".core.chinacloudapi.cn", ".core.cloudapi.de")
CLOUDINARY_PATH = r"(?:^|/)s--[A-Za-z0-9_-]{8}--(?:/|\z)"
MAPS_PATH = r"^/maps/api/(?:staticmap|streetview)(?:/|\z)"
SUPABASE_PATH = r"^/storage/v1/(?:object/sign|render/image/sign)(?:/|\z)"

# The codec's 91 bytes, printable ASCII without the double quote and angle brackets, and the fragment's 81 digits.
CODEC_ALPHABET = "".join(chr(c) for c in range(33, 127) if chr(c) not in '"<>')
FRAGMENT_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-._~!$&'()*+,;=:@/?"

# Class patterns; z stands for the end of the text in both Java and DuckDB.
UUID = r"(?i)(?:^|[^0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}(?:\z|[^0-9a-f])"
HASH = r"(?i)(?:^|[^0-9a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})(?:\z|[^0-9a-f])"
OPAQUE = r"(?:^|[/?#=&])(?:[A-Za-z0-9_-]{20,}|[0-9a-f]{16,})(?:\z|[/?#=&])"

SPLITS = ("train", "seen-host-validation", "seen-host-test", "unseen-host-validation", "unseen-host-test")
