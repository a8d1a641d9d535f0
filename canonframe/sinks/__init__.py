"""Writers: staged builds, promotion, bounded exports, URL lists, review sheets."""
