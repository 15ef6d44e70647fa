"""Column expressions: text, dates, HTML and URLs, labels."""
