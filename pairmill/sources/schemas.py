"""Fixed schemas of the tables; nothing is inferred when files are read."""

# Combined corpus, one JSON object per line.
ARTICLE = "source string, title string, url string, text string, date string, category string, lang string"
# Crawled news, one JSON object per line.
NEWS = (
    "url string, title string, date string, author string, category string, body string, "
    "word_count int, char_count int, source string, language string"
)
# Encyclopedia articles.
ENCYCLOPEDIA = "id long, title string, url string, text string"
# Aligned pairs and test pairs, CSV.
ALIGNED = "title_kk string, title_ru string, text_kk string, text_ru string, score double"
TEST_PAIRS = "text_kk string, text_ru string"
SYSTEM_OUTPUT = "generated string, reference string"
# Page listing and text answers of the encyclopedia interface.
LISTING = "pageid long, title string, ns int, redirect boolean, size long"
PAGE_ANSWER = (
    "query struct<pages: map<string, struct<title: string, fullurl: string, extract: string, missing: string>>>"
)
