"""Scripts: bundled grammars, lexer and parser."""
