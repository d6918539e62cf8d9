"""folioflow: document and access-stream analytics as lazy DataFrame operators."""
