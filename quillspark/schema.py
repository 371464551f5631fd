"""Schemas of the stored documents."""

SHOW = (
    "show_id string, title string, author string, language_detected string, language_confidence double, language_uncertain int, target_index string, "
    "rss_feed_url string, updated_at string, provider string, external_id string, description string, image map<string,string>, "
    "external_urls map<string,string>, categories array<string>, episode_count int, last_episode_at string"
)
PARAGRAPH = "struct<index:int,text:string,char_count:int,flags:array<string>,kept:boolean,rules_hit:array<string>>"
CLEANED_EPISODE = (
    "episode_id string, show_id string, target_index string, "
    f"cleaned struct<normalized:struct<title:string,description:string>,paragraphs:array<{PARAGRAPH}>,"
    "stats:struct<raw_char_count:int,kept_char_count:int,total_paragraphs:int,kept_paragraphs:int,removed_paragraphs:int,removal_breakdown:map<string,int>>>, "
    "original_meta struct<guid:string,pub_date:string,duration:string,audio_url:string,language:string,chapters:array<struct<start:string,title:string>>>, "
    "cleaning_meta struct<pipeline_version:string,rules_version:string,cleaned_at:string>"
)
EMBEDDING_INPUT = "episode_id string, show_id string, embedding_input struct<text:string>"
QUERY_LOG = (
    "request_id string, timestamp string, query string, query_lang string, selected_lang string, mode string, target_index array<string>, "
    "is_cross_lang boolean, result_count int, result_ids array<string>, result_languages array<string>, page int, latency_ms int"
)
CLICK_LOG = (
    "request_id string, timestamp string, query string, selected_lang string, clicked_episode_id string, clicked_rank int, clicked_language string, time_to_click_sec double"
)
EPISODE_STATUS = "episode_id string, show_id string, embedding_status string, embedding_model string, embedding_version string, last_embedded_at string, updated_at string"
SYNC_STATE = (
    "entity_type string, entity_id string, environment string, index_alias string, content_hash string, source_updated_at string, embedding_model string, "
    "embedding_version string, sync_status string, last_synced_at string, last_error string"
)


def check_strict(columns: list[str], fields: str) -> None:
    """Refuse columns that a strict schema does not know."""
    known = {f.strip().split(" ")[0] for f in fields.replace("`", "").split(", ")}
    if extra := [c for c in columns if c not in known]:
        raise ValueError(f"unknown fields: {', '.join(extra)}")
