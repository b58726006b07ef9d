"""Training-data operators: mixing, near-dedup, tokenizing, chat, media, WARC, licences, search, language and quality."""
