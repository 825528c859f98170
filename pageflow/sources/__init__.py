"""Sources and sinks: rule files, settings documents, the bilingual table."""
