"""Fixed values.

Everything in this module is a FIXED VALUE that must equal what the scored
model and the link rules were built with: word lists, column order, labels,
bands and policy lists. They are stated plainly and in their natural order.
The trained model itself (weights, scaler and the 42 kept n-grams) is the
data file ``resources/shipped_model.json``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: page features
# ---------------------------------------------------------------------------

# The 28 stopwords of the stopword_ratio feature.
STOPWORDS = [
    "the", "and", "is", "in", "it", "of", "to", "a", "with", "that", "for",
    "on", "as", "are", "this", "but", "be", "at", "or", "by", "an", "if",
    "from", "about", "into", "over", "after", "under",
]

# The 12 personal pronouns of prp_ratio (matched case-insensitively).
PRONOUNS = ["i", "me", "you", "he", "she", "it", "we", "they", "him", "her", "us", "them"]

# Column order of the 12 numeric model inputs (rows of W_num, mu, sigma).
NUM_COLUMNS = [
    "as_i_x_i_will_y",
    "i_x_that_is_not_y_but_z",
    "iframe_count",
    "inline_css_ratio",
    "links_per_kb",
    "markup_to_text_ratio",
    "prp_ratio",
    "sentences_per_paragraph",
    "stopword_ratio",
    "straight_apostrophe",
    "type_token_ratio",
    "vbg",
]

# Human readable reason per numeric feature (explanations).
FEATURE_LABELS = {
    "as_i_x_i_will_y": "Phrases with the structure 'As I …, I will …'",
    "i_x_that_is_not_y_but_z": "Phrases with the structure 'I … that is not …, but …'",
    "iframe_count": "Contains <iframe> elements",
    "inline_css_ratio": "Uses lots of inline CSS styling",
    "links_per_kb": "Has many hyperlinks",
    "markup_to_text_ratio": "High markup-to-text proportion",
    "prp_ratio": "Uses personal pronouns",
    "sentences_per_paragraph": "Multiple sentences per paragraph",
    "stopword_ratio": "High use of common words",
    "straight_apostrophe": "Contains straight apostrophes",
    "type_token_ratio": "Diverse vocabulary",
    "vbg": "Contains words ending in -ing",
}

# Deprecated presentational tags (wider feature set).
DEPRECATED_TAGS = ["font", "center", "marquee", "bgsound", "spacer"]

# Lengths of the kept n-grams of the shipped model.
ALLOWED_GRAM_LENGTHS = [4, 5, 6, 7, 8, 9, 10]

# ---------------------------------------------------------------------------
# FIXED VALUES: link scoring of a listing page
# ---------------------------------------------------------------------------

LINK_PENALTY = 500
GENERIC_TITLES = ["404", "page not found", "home", "homepage", "index", "untitled"]
SKIP_KEYWORDS = [
    "privacy", "terms", "login", "subscribe", "contact", "about", "settings",
    "account", "register", "cookies", "help", "sitemap", "advertise", "donate",
    "events", "newsletter", "careers", "faq", "feedback", "preferences",
    "signup", "auth", "admin", "navigation", "guidelines", "accessibility",
    "schedules", "live", "bracket-odds", ".com/users/", "/video/watch",
    "/give/", "/assessment/",
]
SOCIAL_DOMAINS = [
    "facebook.com", "twitter.com", "instagram.com", "youtube.com",
    "linkedin.com", "tiktok.com",
]
ARTICLE_KEYWORDS = ["article"]
NON_ARTICLE_ENDINGS = [
    "jpg", "jpeg", "png", "gif", "svg", "pdf", "mp4", "mp3", "webp", "ico",
    "css", "js", "#comments",
]
LINK_PREFIXES_OK = ["http://", "https://", "/"]

# ---------------------------------------------------------------------------
# FIXED VALUES: link policy and score bands
# ---------------------------------------------------------------------------

# Built-in allow list used when the user list is empty (143 host patterns).
DEFAULT_ALLOW_LIST = [
    "adobe.com",
    "acrobat.com",
    "pdf.com",
    "office.net",
    "wetransfer.com",
    "dropbox.com",
    "box.com",
    "onedrive.com",
    "docs.google.com",
    "drive.google.com",
    "icloud.com",
    "docsend.com",
    "scribd.com",
    "file.io",
    "sendgb.com",
    "transfer.sh",
    "zippyshare.com",
    "mediafire.com",
    "mega.nz",
    "filemail.com",
    "khanacademy.org",
    "coursera.org",
    "edx.org",
    "udemy.com",
    "duolingo.com",
    "openai.com",
    "code.org",
    "alison.com",
    "futurelearn.com",
    "udacity.com",
    "mit.edu",
    "stanford.edu",
    "harvard.edu",
    "ocw.mit.edu",
    "academicearth.org",
    "open.edu",
    "skillshare.com",
    "brilliant.org",
    "codecademy.com",
    "lynda.com",
    "pluralsight.com",
    "sololearn.com",
    "study.com",
    "chegg.com",
    "quizlet.com",
    "byjus.com",
    "edmodo.com",
    "github.com",
    "githubusercontent.com",
    "gitlab.com",
    "bitbucket.org",
    "sourceforge.net",
    "npmjs.com",
    "pypi.org",
    "rubygems.org",
    "docker.com",
    "hub.docker.com",
    "python.org",
    "nodejs.org",
    "perl.org",
    "cpan.org",
    "cran.r-project.org",
    "r-project.org",
    "anaconda.com",
    "readthedocs.io",
    "maven.apache.org",
    "packagist.org",
    "nuget.org",
    "dotnet.microsoft.com",
    "jetbrains.com",
    "vscode.dev",
    "visualstudio.com",
    "eclipse.org",
    "gnome.org",
    "kde.org",
    "slackbuilds.org",
    "freecodecamp.org",
    "f-droid.org",
    "osdn.net",
    "wikipedia.org",
    "wikimedia.org",
    "archive.org",
    "arxiv.org",
    "nature.com",
    "sciencedirect.com",
    "ncbi.nlm.nih.gov",
    "nih.gov",
    "pubmed.ncbi.nlm.nih.gov",
    "springer.com",
    "sciencemag.org",
    "newscientist.com",
    "encyclopedia.com",
    "britannica.com",
    "infoplease.com",
    "wolframalpha.com",
    "stackexchange.com",
    "stackoverflow.com",
    "quora.com",
    "snopes.com",
    "factcheck.org",
    "politifact.com",
    "reuters.com",
    "bbc.com",
    "bbc.co.uk",
    "nytimes.com",
    "ft.com",
    "economist.com",
    "wsj.com",
    "bloomberg.com",
    "apnews.com",
    "npr.org",
    "theguardian.com",
    "theatlantic.com",
    "forbes.com",
    "techcrunch.com",
    "wired.com",
    "arstechnica.com",
    "engadget.com",
    "cnet.com",
    "zdnet.com",
    "pcmag.com",
    "slashdot.org",
    "hackernews.com",
    "producthunt.com",
    "vox.com",
    "vice.com",
    "nationalgeographic.com",
    "smithsonianmag.com",
    "time.com",
    "newsweek.com",
    "usnews.com",
    "usatoday.com",
    "cnn.com",
    "abcnews.go.com",
    "cbsnews.com",
    "nbcnews.com",
    "pbs.org",
    "aljazeera.com",
    "dw.com",
    "cbc.ca",
    "globalnews.ca",
    "sciencenews.org",
    "journals.aps.org",
]

# Score bands on the "ok" score (upper bounds, exclusive) and their labels.
SCORE_BANDS = [(0.15, "Slop!"), (0.3, "Risk"), (0.6, "Hmm")]
TOP_BAND = "No Slop"

# Any url holding this text is let through without scoring.
ALWAYS_OK_HOST_TEXT = "google.com"

# Class labels of the training data.
LABEL_SLOP = "Slop"
LABEL_NOT_SLOP = "Non-Slop"
