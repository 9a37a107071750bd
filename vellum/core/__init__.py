"""What happens inside one document: bytes to tokens, objects, streams, pages, operators and features. No Spark here."""
