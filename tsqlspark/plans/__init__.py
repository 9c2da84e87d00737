"""Front end: lexer, parser and binder."""
